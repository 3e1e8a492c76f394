import glob
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from lendgauge.functions.scores import score_of
from lendgauge.operators import clean, evaluate, monitor, scoring, split, train
from lendgauge.plans.report import write_model_report
from lendgauge.sources import tables
from lendgauge.sources.models import ScorecardModel


def test_auc_equals_evaluator_and_paths_agree(app):
    exact = BinaryClassificationEvaluator(rawPredictionCol="proba", labelCol="label", numBins=0).evaluate(app)
    for small_group in (1_000_000, 100):
        one = evaluate.ks_auc(app, small_group=small_group).first()
        assert one["auc"] == pytest.approx(exact, abs=1e-9)
    assert evaluate.ks_auc(app, digits=2).first()["auc"] == pytest.approx(exact, abs=0.02)


def test_one_class_group(spark):
    df = spark.createDataFrame([("a", 0.1, 0), ("a", 0.2, 0), ("b", 0.1, 0), ("b", 0.9, 1)], "g string, proba double, label int")
    assert {r["g"]: (r["ks"], r["auc"]) for r in evaluate.ks_auc(df, ["g"]).collect()} == {"a": (0.0, 0.5), "b": (1.0, 1.0)}


@pytest.mark.parametrize("few", [32, 0])
@pytest.mark.parametrize("small_group", [1_000_000, 7])
def test_ks_and_auc_equal_plain_ones(spark, monkeypatch, small_group, few):
    """Ties, both zeros, NaN, missing scores, labels, weights and groups; pieces of any size."""
    monkeypatch.setattr(evaluate, "FEW_GROUPS", few)
    monkeypatch.setattr(evaluate, "LEAST_PIECE", min(small_group, evaluate.LEAST_PIECE))
    generator = random.Random(4)
    rows = [(generator.choice(["a", None, "b"]), generator.choice([0.0, -0.0, float("nan"), None, round(generator.random(), 1), generator.random()]),
             generator.choice([0, 0, 1, None]), generator.choice([1.0, 2.5, None])) for _ in range(400)]
    rows += [("one", 0.1, 1, 1.0), ("none", None, 1, 1.0)]
    df = spark.createDataFrame(rows, "g string, s double, label int, w double").repartition(3)
    got = {r.g: (r.ks, r.auc) for r in evaluate.ks_auc(df, ["g"], "s", "label", "w", small_group).collect()}
    assert set(got) == {"a", "b", None, "one"} and got["one"] == (0.0, 0.5)
    for g in ("a", "b", None):
        own = [(float("inf") if s != s else s, y, w or 0.0) for k, s, y, w in rows if k == g and s is not None and y is not None]
        good, bad = (sum(w for _, y, w in own if y == v) for v in (0, 1))
        pairs = sum(v * w * (0.5 if s == t else s < t) for s, y, w in own for t, z, v in own if y == 0 and z == 1)
        ks = max(abs(sum(w for s, y, w in own if y == 0 and s <= t) / good - sum(w for s, y, w in own if y == 1 and s <= t) / bad) for t, _, _ in own)
        assert got[g] == (pytest.approx(ks), pytest.approx(pairs / good / bad))
    assert evaluate.ks_auc(df.where("false"), ["g"], "s").collect() == []


def test_score_falls_with_probability(spark):
    df = spark.createDataFrame([(i / 100,) for i in range(101)], "proba double")
    scores = [r["score"] for r in scoring.with_score(df).orderBy("proba").collect()]
    assert all(a > b for a, b in zip(scores, scores[1:])) and scores[50] == pytest.approx(score_of(0.5))


@pytest.mark.parametrize("low,high", [(0.02, 0.9), (0.4, 0.6), (1e-6, 1 - 1e-6), (0.5, 0.5)])
def test_auto_scale_keeps_limits_or_says_so(spark, low, high):
    config = scoring.auto_scale(spark.createDataFrame([(low,), (high,)], "proba double"))
    ends = [score_of(p, config["pdo"], config["base_odds"], config["base_score"]) for p in (high, low)]
    if config["converged"]:
        assert ends[0] >= 300 and ends[1] <= 900 and 360 < ends[1] - ends[0] < 600
    assert config["converged"] == (low != high)


def test_distribution_counts_all_rows(app):
    scored = scoring.with_score(app)
    one = evaluate.score_distribution(scored).first()
    assert len(one["bins"]) == 21 and sum(one["counts_good"]) + sum(one["counts_bad"]) == app.count()
    row = monitor.monitor_scores(scored, one.asDict()).first()
    assert row["psi"] == pytest.approx(0, abs=1e-12) and sum(row["counts"]) == row["sample_size"]


def plain_objective(kind, m, th):
    t, v = m["train_ks"], m["valid_ks"]
    o = m.get("oot_ks", v)
    pen = -(abs(t - o) + abs(t - v))
    if kind == 3:
        return o if max(abs(t - o), abs(t - v), abs(o - v)) < th else pen
    if kind == 201:
        return 0.9 * (v + o) + 0.1 * m.get("oot_top_5_lift", 0) if abs(t - v) < 0.1 and abs(t - o) < 0.1 else pen
    if kind == 26:
        return plain_objective(3, {k.replace("auc", "ks"): x for k, x in m.items() if "auc" in k}, th)
    if kind == 2:
        return t - 0.2 * abs(t - o)
    return v


@pytest.mark.parametrize("kind", [2, 3, 26, 201, 999])
def test_objectives(spark, kind):
    generator = random.Random(kind)
    metrics = [{f"{s}_{m}": 0.3 + generator.random() * 0.05 for s in ("train", "valid", "oot") for m in ("ks", "auc")} for _ in range(20)]
    del metrics[3]["oot_ks"]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(metrics)], "trial int, metrics map<string,double>")
    rows = df.withColumn("v", train.objective_of_maps("metrics", kind, 0.03)).collect()
    for r in rows:
        assert r["v"] == pytest.approx(plain_objective(kind, metrics[r["trial"]], 0.03))


def test_best_trial_takes_first_of_equals(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.3), (2, 0.3)], "trial int, oot_ks double")
    assert train.best_trial(df).first()["trial"] == 1


def test_train_save_load_score_and_report(app, spark, tmp_path):
    columns = ["amount", "balance", "n_items", "segment"]
    space = {"C": ("log", 0.5, 1.0), "maxIter": ("int", 10, 10)}
    model, trials = train.train_scorecard(app, columns, n_trials=2, space=space, score_config={"mode": "auto"})
    assert trials.count() == 2 and model.metrics["train_auc"] > 0.5
    loaded = ScorecardModel.load(spark, model.save(str(tmp_path / "model")))
    strange = app.withColumn("segment", F.when(F.col("app_id") == 0, "never seen").otherwise(F.col("segment")))
    a, b = (m.score(strange).orderBy("app_id").select("score").collect() for m in (model, loaded))
    assert a == b and all(r["score"] is not None for r in a)
    assert monitor.monitor_model(loaded, app).first()["sample_size"] == app.count()
    paths = write_model_report(app, loaded, str(tmp_path / "report"), "apply_time")
    assert set(paths) == {"data_summary", "performance", "feature_importance", "bin_details", "lift_table", "psi_train_oot",
                          "psi_monthly", "scaling"}
    assert spark.read.parquet(paths["performance"]).where("datasets = 'train'").count() == 1


def test_text_label(spark):
    df = spark.createDataFrame([("bad",), ("good",), (None,)], "label string")
    assert [r[0] for r in train.numeric_label(df, "label").collect()] == [0, 1, None]


# ---------------------------------------------------------------- splits and files

def test_stratified_quota_is_exact_on_both_paths(app):
    found = [split.split_dataset(app.drop("target"), "app_id", ratios=[0.6, 0.2, 0.2], small_group=n).select("app_id", "split")
             for n in (1_000_000, 300)]
    assert found[0].exceptAll(found[1]).count() == 0
    sizes = {(r["label"], r["split"]): r["count"] for r in found[0].join(app, "app_id").groupBy("label", "split").count().collect()}
    n = app.where("label = 1").count()
    assert sizes[(1, "train")] == int(n * 0.6)


def test_time_share_with_ties_and_missing_times(spark):
    rows = [(i, 202400 + 1 + i // 40 if i >= 10 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, month int")
    for small_group in (1_000_000, 5):
        tagged = split.tag_oot_by_share(df, "month", "id", 0.3, small_group=small_group)
        assert {r["id"] for r in tagged.where("split = 'oot'").collect()} == set(range(70, 100))
    late = split.tag_oot_by_share(df, "month", "id", 0.05, null_times="oot")
    assert {r["id"] for r in late.where("split = 'oot'").collect()} == set(range(5, 10))


def test_category_codes_are_dense_and_stable(spark):
    df = spark.createDataFrame([(f"v{i % 700}",) for i in range(3000)] + [(None,)], "c string")
    codes = clean.category_codes(df, ["c"])
    assert sorted(r["code"] for r in codes.collect()) == [float(i) for i in range(700)]
    encoded = clean.encode_categories(df, codes, ["c"])
    assert encoded.where("c is null").count() == 1 and encoded.count() == 3001


def test_reading_and_writing(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "x"), (2, 2.5, None)], "id int, v double, s string")
    path = str(tmp_path / "data.parquet")
    df.write.parquet(path)
    assert tables.read_table(spark, path).where("v is null").count() == 1
    text = str(tmp_path / "data.csv")
    df.where("id = 2").coalesce(1).write.option("header", True).csv(text)
    assert dict(tables.read_table(spark, text).dtypes)["v"] == "double"
    filled = clean.impute(tables.read_table(spark, path))
    target = tables.write_snapshot(filled, path, stamp=7)
    assert target.endswith("data_imputed_7.parquet") and spark.read.parquet(target).where("v = -999").count() == 1
    with pytest.raises(Exception):
        tables.write_snapshot(filled, path, stamp=7)
    with pytest.raises(ValueError):
        tables.write_csv_detail(df, str(tmp_path / "detail.txt"))
    detail = tables.write_csv_detail(df, str(tmp_path / "detail.csv"))
    assert len(glob.glob(detail + "/part-*")) == 1
    log = str(tmp_path / "log")
    for n in range(3):
        tables.append_log(spark.createDataFrame([(0.05 * n,)], "psi double").withColumn(
            "created_at", F.timestamp_seconds(F.lit(1000 * n))), log, f"b{n}")
    newest = monitor.recent_logs(spark.read.parquet(log), 2).collect()
    assert [r["batch_name"] for r in newest] == ["b2", "b1"] and newest[0]["band"] == "attention"


def test_a_forest_deals_out_rows_by_their_bagged_size(spark):
    rows = spark.range(0, 4000, 1, 3).select(F.col("id").cast("double").alias("_x0"), (F.col("id") % 2).alias("label"))
    assert train.dealt_for_forest(rows, 100, 1) is rows
    dealt = train.dealt_for_forest(rows, 100, 1, bagged_bytes=100_000)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) * 908 < 150_000


def test_a_search_gathers_few_rows_in_few_tasks(spark, monkeypatch):
    """Passes over the rows take no more tasks than there are cores, however many partitions the table has."""
    df = spark.range(0, 600, 1, 60).select(
        (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3 == 0).cast("int").alias("label"),
        F.element_at(F.array(F.lit("train"), F.lit("valid"), F.lit("oot")), (F.col("id") % 5 % 3 + 1).cast("int")).alias("target"))
    seen, fit = [], train.fit_model
    monkeypatch.setattr(train, "fit_model", lambda *a, **k: seen.append(a[8].rdd.getNumPartitions()) or fit(*a, **k))
    _, trials = train.search(df, ["x"], n_trials=2, seed=3, parallel=1)
    assert trials.count() == 2 and max(seen) <= spark.sparkContext.defaultParallelism


def test_a_search_prepares_rows_once_and_fits_few_trials_of_many_rows_together(app, spark, monkeypatch):
    """Trials read rows that were prepared once; of rows that together would be too many to keep, one fit follows the other."""
    space = {"C": ("log", 0.5, 1.0), "maxIter": ("int", 5, 5)}
    calls, running, most, prepared, fit = [], [], [], ScorecardModel.prepared, train.fit_model

    def watched(*args, **kwargs):
        running.append(1)
        most.append(len(running))
        try:
            return fit(*args, **kwargs)
        finally:
            running.pop()

    monkeypatch.setattr(ScorecardModel, "prepared", lambda self, df: calls.append(1) or prepared(self, df))
    monkeypatch.setattr(train, "fit_model", watched)
    found = []
    for limit in (train.SEARCH_BYTES, 1):
        monkeypatch.setattr(train, "SEARCH_BYTES", limit)
        _, trials = train.search(app, ["amount", "balance", "segment"], n_trials=3, seed=3, space=space, parallel=3)
        found.append({r.trial: (r.params, {k: round(v, 6) for k, v in r.metrics.items()}) for r in trials.collect()})
    assert len(calls) == 2 and max(most[3:]) == 1
    assert found[0] == found[1] and len(found[0]) == 3


def test_a_regression_scores_the_same_as_one_expression(app):
    columns = ["amount", "balance", "segment"]
    model = train.fit_model(app, columns, params={"C": 0.5, "maxIter": 20})
    ready = model.prepared(app)
    both = [{r.app_id: r.proba for r in model.probabilities(ready, prepared=True, plain=plain).select("app_id", "proba").collect()} for plain in (False, True)]
    assert both[0].keys() == both[1].keys() and all(abs(both[0][k] - both[1][k]) < 1e-14 for k in both[0])
