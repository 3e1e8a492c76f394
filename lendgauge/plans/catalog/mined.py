"""Queries that fit models, mine rules and monitor batches and streams."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...operators import binning, boosting, evaluate, mining, monitor, psi, random_trees, scoring, train, woe
from ...session import new_place
from ...sources.models import ScorecardModel
from ...streaming import drift
from .. import report
from ..loanbook import NUMERIC_FEATURES, applications, kept_applications
from .bins import BINNED, SETS, app_and_cuts
from .decisions import BASELINE, COLUMNS, EXPERIMENT
from .models import LIFT_NAMES, SCORED, scored
from .registry import STATEMENTS, binned_part, cuts_part, long_part, on_app, query, rounded, woe_part

FEATURES = NUMERIC_FEATURES
MODEL_COLUMNS = [*FEATURES, "segment", "label", "target", "weight"]
FITTED = [*FEATURES, "segment"]


# ---------------------------------------------------------------- models

def fitted_model(spark, folder, kind="lr", **params):
    app = kept_applications(spark, folder, MODEL_COLUMNS)
    return train.fit_model(app.where(F.col("target") == "train"), FITTED, model_type=kind, params=params), app


@query("train_regression")
def train_regression(spark, folder):
    model, app = fitted_model(spark, folder, "lr", C=0.5, maxIter=100)
    return rounded(evaluate.ks_auc(model.probabilities(app), ["target"], weight="weight"))


@query("train_boosted_trees")
def train_boosted_trees(spark, folder):
    model, app = fitted_model(spark, folder, "xgb", n_estimators=100, max_depth=3, learning_rate=0.2, subsample=0.8, colsample_bytree=0.8)
    return rounded(evaluate.ks_auc(model.probabilities(app), ["target"], weight="weight"))


BOOST = {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.3, "reg_lambda": 2.0, "reg_alpha": 0.5, "min_child_weight": 20.0}


def boosting_sql(depth=BOOST["max_depth"], trees=BOOST["n_estimators"], unit=1 << 24):
    """Statement that grows the trees from sums per node, feature and bin, level by level."""
    lam, alpha, least, rate = (f"{BOOST[k]}::DOUBLE" for k in ("reg_lambda", "reg_alpha", "min_child_weight", "learning_rate"))
    score = lambda g, h: f"power(greatest(abs({g}) - {alpha}, 0), 2) / ({h} + {lam})"
    names = "[" + ", ".join(f"'{f}'" for f in FEATURES) + "]"
    parts = [
        long_part(), cuts_part(), binned_part(),
        f"lb AS (SELECT app_id, list_position({names}, feature) - 1 AS f, CASE WHEN value IS NULL THEN 0 ELSE bin END AS bin FROM binned WHERE target = 'train')",
        f"grid AS (SELECT list_position({names}, feature) - 1 AS f, feature, list_sort(cuts) AS cuts, unnest(range(0, len(cuts) + 2)) AS bin FROM cuts)",
        "rows0 AS (SELECT app_id, label::DOUBLE AS y, weight AS w, ln(p / (1 - p)) AS margin FROM app, "
        "(SELECT sum(weight * label) / sum(weight) AS p FROM app WHERE target = 'train') WHERE target = 'train')"]
    found = []
    for t in range(trees):
        parts.append(f"n{t}_0 AS (SELECT app_id, floor(w * (p - y) * {unit} + 0.5::DOUBLE) AS g, floor(w * p * (1 - p) * {unit} + 0.5::DOUBLE) AS h, 0 AS node "
                     f"FROM (SELECT *, 1 / (1 + exp(-margin)) AS p FROM rows{t}))")
        for d in range(depth):
            at = f"{t}_{d}"
            parts += [
                f"c{at} AS (SELECT node, f, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM n{at} JOIN lb USING (app_id) WHERE node >= {2 ** d - 1} GROUP BY ALL)",
                f"d{at} AS (SELECT o.node, r.f, r.feature, r.bin, r.cuts, coalesce(c.g, 0) / {unit} AS g, coalesce(c.h, 0) / {unit} AS h, coalesce(c.n, 0) AS n "
                f"FROM (SELECT DISTINCT node FROM c{at}) o CROSS JOIN grid r LEFT JOIN c{at} c ON c.node = o.node AND c.f = r.f AND c.bin = r.bin)",
                f"""r{at} AS (SELECT node, f, feature, bin, cuts, m, g1 - CASE WHEN m THEN 0 ELSE g0 END AS gl, h1 - CASE WHEN m THEN 0 ELSE h0 END AS hl,
  n1 - CASE WHEN m THEN 0 ELSE n0 END AS nl, gt, ht, nt
  FROM (SELECT *, {", ".join(f"sum({c}) OVER (PARTITION BY node, f ORDER BY bin) AS {c}1, sum({c}) OVER (PARTITION BY node, f) AS {c}t, "
                              f"sum(CASE WHEN bin = 0 THEN {c} ELSE 0 END) OVER (PARTITION BY node, f) AS {c}0" for c in "ghn")} FROM d{at}), (VALUES (true), (false)) s(m))""",
                f"""b{at} AS (SELECT * FROM (SELECT *, {score("gl", "hl")} + {score("gt - gl", "ht - hl")} - {score("gt", "ht")} AS gain FROM r{at})
  WHERE bin > 0 AND least(nl, nt - nl) >= 1 AND least(hl, ht - hl) >= {least} AND gain > 1e-6
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, bin, m DESC) = 1)""",
                f"""n{t}_{d + 1} AS (SELECT n.app_id, n.g, n.h, CASE WHEN b.node IS NULL THEN n.node
    WHEN (lb.bin = 0 AND b.m) OR (lb.bin > 0 AND lb.bin <= b.bin) THEN 2 * n.node + 1 ELSE 2 * n.node + 2 END AS node
  FROM n{at} n LEFT JOIN b{at} b ON n.node = b.node LEFT JOIN lb ON lb.app_id = n.app_id AND lb.f = b.f)"""]
            found.append(f"SELECT {t} AS tree, node, feature, CAST(bin AS INT) AS bin, round(cuts[bin], 6) AS cut, m AS missing_left, "
                         f"round(gain, 4) AS gain, round(ht, 4) AS cover, CAST(NULL AS DOUBLE) AS value FROM b{at}")
        parts += [
            f"l{t} AS (SELECT node, h, -sign(g) * greatest(abs(g) - {alpha}, 0) / (h + {lam}) * {rate} AS value "
            f"FROM (SELECT node, sum(g) / {unit} AS g, sum(h) / {unit} AS h FROM n{t}_{depth} GROUP BY node))",
            f"rows{t + 1} AS (SELECT r.app_id, r.y, r.w, r.margin + l.value AS margin FROM rows{t} r JOIN n{t}_{depth} n USING (app_id) JOIN l{t} l ON l.node = n.node)"]
        found.append(f"SELECT {t}, node, NULL, NULL, NULL, NULL, NULL, round(h, 4), round(value, 6) FROM l{t}")
    body = " UNION ALL ".join(found)
    return on_app(f"SELECT CAST(tree AS INT) AS tree, CAST(node AS INT) AS node, feature, bin, cut, missing_left, gain, cover, value FROM ({body})", *parts)


@query("boosted_tree_nodes", boosting_sql())
def boosted_tree_nodes(spark, folder):
    train_rows = kept_applications(spark, folder, [*FEATURES, "label", "target", "weight"]).where(F.col("target") == "train")
    cuts = {c: [x for x in e if abs(x) != float("inf")] for c, e in binning.equal_frequency_cuts(train_rows, FEATURES).items()}
    nodes = boosting.fit(train_rows, FEATURES, weight="weight", params=BOOST, cuts=cuts).nodes(spark)
    return nodes.withColumns({"cut": F.round("cut", 6), "gain": F.round("gain", 4), "cover": F.round("cover", 4), "value": F.round("value", 6)})


@query("train_forest")
def train_forest(spark, folder):
    model, app = fitted_model(spark, folder, "rf", numTrees=100, maxDepth=4)
    return rounded(evaluate.ks_auc(model.probabilities(app), ["target"], weight="weight"))


@query("train_tree")
def train_tree(spark, folder):
    model, app = fitted_model(spark, folder, "dt", maxDepth=4, minInstancesPerNode=20)
    return rounded(evaluate.ks_auc(model.probabilities(app), ["target"], weight="weight"))


@query("class_weights", on_app(
    "SELECT label, round(SUM(weight * n / (2 * k)), 6) AS weight FROM (SELECT label, weight, COUNT(*) OVER () AS n, "
    "COUNT(*) OVER (PARTITION BY label) AS k FROM app WHERE target = 'train') GROUP BY label"))
def class_weights(spark, folder):
    app = applications(spark, folder, ["label", "weight", "target"]).where(F.col("target") == "train")
    weight = train.training_weight(app, "label", "weight", balanced=True)
    return rounded(app.groupBy("label").agg(F.sum(weight).alias("weight")))


@query("parameter_search")
def parameter_search(spark, folder):
    _, trials = train.search(kept_applications(spark, folder, MODEL_COLUMNS), FITTED, n_trials=30, seed=7)
    return trials.select("trial", F.to_json("params").alias("params"), F.round("value", 6).alias("value"),
                         *[F.round(F.col("metrics")[f"{s}_{m}"], 6).alias(f"{s}_{m}") for s in SETS for m in ("ks", "auc")])


def single_feature_trials(spark, folder):
    """KS per split of every feature's bins, one feature per trial."""
    app, cuts = app_and_cuts(spark, folder)
    return woe.ks_by_set(app, cuts)


KS_PART = ("tr AS (SELECT feature, " + ", ".join(f"max(CASE WHEN target = '{s}' THEN ks END) AS {s}_ks" for s in SETS)
           + " FROM woe GROUP BY feature)")
def objectives():
    """Expression of every objective over the columns of ``tr``, by number."""
    gap = lambda a, b, m: f"abs({a}_{m} - {b}_{m})"
    penalty = lambda m: f"-({gap('train', 'oot', m)} + {gap('train', 'valid', m)})"
    aligned = lambda limit, m="ks": (
        f"CASE WHEN greatest({gap('train', 'oot', m)}, {gap('train', 'valid', m)}, {gap('valid', 'oot', m)}) < {limit} THEN oot_{m} ELSE {penalty(m)} END")
    near = lambda limit, m="ks": f"CASE WHEN {gap('train', 'valid', m)} < {limit} THEN valid_{m} ELSE -{gap('train', 'valid', m)} END"
    both = f"{gap('train', 'oot', 'ks')} < 0.1 AND {gap('train', 'valid', 'ks')} < 0.1"
    found = {
        1: f"oot_ks - 0.2::DOUBLE * {gap('train', 'oot', 'ks')} - 0.2::DOUBLE * {gap('valid', 'oot', 'ks')}",
        2: f"train_ks - 0.2::DOUBLE * {gap('train', 'oot', 'ks')}",
        3: aligned(0.03), 4: aligned(0.02), 5: aligned(0.04), 1348: aligned(0.05), 1349: aligned(0.03), 1350: aligned(0.02), 26: aligned(0.03, "auc"),
        6: f"CASE WHEN {gap('train', 'oot', 'ks')} < 0.3 AND {gap('train', 'valid', 'ks')} < 0.1 THEN oot_ks ELSE {penalty('ks')} END",
        10: f"CASE WHEN {both} THEN (valid_ks + oot_ks) / 2 ELSE {penalty('ks')} END",
        11: near(0.03), 12: near(0.03), 20: near(0.02, "auc"),
        201: f"CASE WHEN {both} THEN (valid_ks + oot_ks) * 0.9::DOUBLE + oot_lift * 0.1::DOUBLE ELSE {penalty('ks')} END"}
    return found | {k: "valid_ks" for k in (7, 8, 9)} | {k: "valid_auc" for k in (21, 22, 23, 24, 25, 27)}


OBJECTIVES = objectives()
#: A trial per feature: KS and AUC of its bins, in their order, and the lift of the last bin.
FEATURE_TRIALS = ("ft AS (SELECT feature, target, max(ks) AS ks, SUM(bad / tb * (good_cum - good / 2) / tg) AS auc, arg_max(lift, bin) AS lift FROM woe GROUP BY ALL)",
                  "tr AS (SELECT feature, max(lift) FILTER (target = 'oot') AS oot_lift, "
                  + ", ".join(f"max({m}) FILTER (target = '{s}') AS {s}_{m}" for s in SETS for m in ("ks", "auc")) + " FROM ft GROUP BY feature)")


@query("trial_objectives", on_app(
    "SELECT feature, " + ", ".join(f"round({e}, 6) AS objective_{k}" for k, e in OBJECTIVES.items()) + " FROM tr",
    *BINNED, woe_part(["feature", "target"]), *FEATURE_TRIALS))
def trial_objectives(spark, folder):
    app, cuts = app_and_cuts(spark, folder)
    bins = woe.woe_table(app, cuts, by=["target"])
    group = Window.partitionBy("feature", "target")
    rated = bins.withColumn("_part", F.col("bad") / F.sum("bad").over(group) * (F.sum("good").over(group.orderBy("bin")) - F.col("good") / 2) / F.sum("good").over(group))
    measured = rated.groupBy("feature", "target").agg(F.max("ks").alias("ks"), F.sum("_part").alias("auc"), F.max_by("lift", "bin").alias("lift"))
    of = lambda s, m: F.max(F.when(F.col("target") == s, F.col(m)))
    trials = measured.groupBy("feature").agg(of("oot", "lift").alias("oot_top_5_lift"), *[of(s, m).alias(f"{s}_{m}") for s in SETS for m in ("ks", "auc")])
    return rounded(trials.select("feature", *[train.objective(k, 0.03).alias(f"objective_{k}") for k in OBJECTIVES]))


@query("best_trial", on_app("SELECT feature, round(oot_ks, 6) AS oot_ks FROM tr ORDER BY oot_ks DESC, feature LIMIT 1",
                            *BINNED, woe_part(["feature", "target"]), KS_PART))
def best_trial(spark, folder):
    return rounded(train.best_trial(single_feature_trials(spark, folder), trial="feature").select("feature", "oot_ks"))


@query("feature_importance")
def feature_importance(spark, folder):
    model, app = fitted_model(spark, folder, "rf", numTrees=100, maxDepth=4)
    cuts = binning.equal_frequency_cuts(app.where(F.col("target") == "train"), FEATURES)
    return rounded(train.importance_table(model, woe.iv_by_set(app, cuts), woe.ks_by_set(app, cuts)))


@query("batch_scoring")
def batch_scoring(spark, folder):
    model, app = fitted_model(spark, folder, "lr", C=0.5, maxIter=50)
    with_ids = kept_applications(spark, folder, ["app_id", *MODEL_COLUMNS])
    from ...functions.predicates import Rule

    scored_app = scoring.with_model_scores(with_ids, [Rule("_model_result_7", "<", 600)], {7: model})
    return rounded(scored_app.select("app_id", F.col("_model_result_7").alias("score")))


@query("saved_model_scoring")
def saved_model_scoring(spark, folder):
    model, app = fitted_model(spark, folder, "lr", C=0.5, maxIter=50)
    place = new_place(spark, "model")
    loaded = ScorecardModel.load(spark, model.save(place))
    return rounded(loaded.score(app).groupBy("target").agg(F.avg("score").alias("avg_score"), F.count("*").alias("n")))


def report_sections(spark, folder):
    app = scored(spark, folder, [*FEATURES, "label", "target", "weight", "month_time"])
    edges = binning.equal_frequency_cuts(app.where(F.col("target") == "train"), FEATURES)
    return report.model_report(app, FEATURES, edges=edges)


@query("model_report_summary", on_app(
    """SELECT 'bad_rate_all' AS figure, round(avg(label), 6) AS value FROM app
    UNION ALL SELECT 'months', COUNT(DISTINCT month_time)::DOUBLE FROM app
    UNION ALL SELECT 'bins', COUNT(*)::DOUBLE FROM woe UNION ALL SELECT 'total_iv', round(SUM(iv), 6) FROM woe""",
    *BINNED, woe_part(["feature"])))
def model_report_summary(spark, folder):
    sections = report_sections(spark, folder)
    summary, bins = sections["data_summary"], sections["bin_details"]
    parts = [
        summary.where("section = 'all'").select(F.lit("bad_rate_all").alias("figure"), F.col("badrate").alias("value")),
        sections["psi_monthly"].agg(F.count("*").cast("double").alias("value")).select(F.lit("months").alias("figure"), "value"),
        bins.agg(F.count("*").cast("double").alias("value")).select(F.lit("bins").alias("figure"), "value"),
        bins.agg(F.sum("iv").alias("value")).select(F.lit("total_iv").alias("figure"), "value")]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return rounded(result)


@query("model_report_performance", STATEMENTS["performance_table"])
def model_report_performance(spark, folder):
    return rounded(report_sections(spark, folder)["performance"].select("datasets", "auc", "ks", *LIFT_NAMES))


# ---------------------------------------------------------------- mined rules

RULES = ["amount > 400000.0 and balance <= 1000.0", "amount > 450000.0", "balance <= 0.0 and n_items > 4.0",
         "amount > 300000.0 and qty <= 60.0", "amount > 480000.0", "avg_disc > 0.06 and amount > 350000.0"]
HITS = ["amount > 400000 AND balance <= 1000", "amount > 450000", "balance <= 0 AND COALESCE(n_items > 4, false)",
        "amount > 300000 AND COALESCE(qty <= 60, false)", "amount > 480000", "COALESCE(avg_disc > 0.06, false) AND amount > 350000"]
RULE_COLUMNS = ["app_id", "apply_time", *FEATURES, "label"]
TAGGED = ("tg AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY apply_time, app_id) <= floor(COUNT(*) OVER () * 0.7::DOUBLE) + 1 "
          "THEN 'train' ELSE 'test' END AS g FROM app)")
PARTS = {"train": "g = 'train'", "test": "g = 'test'", "all": "true"}


def rule_numbers(hit, rule, number):
    figures = []
    for part, inside in PARTS.items():
        figures += [f"CAST(COALESCE(SUM(label) FILTER ({inside} AND {hit}), 0) AS DOUBLE) AS bad_{part}",
                    f"COUNT(*) FILTER ({inside} AND {hit}) AS total_{part}",
                    f"CAST(SUM(label) FILTER ({inside}) AS DOUBLE) AS b_{part}", f"COUNT(*) FILTER ({inside}) AS t_{part}"]
    return f"SELECT {number} AS rule_id, '{rule}' AS rule, {', '.join(figures)} FROM tg"


RATES = ", ".join(f"CASE WHEN total_{p} > 0 THEN bad_{p} / total_{p} ELSE 0 END AS r_{p}" for p in PARTS)
MEASURED = ("measured AS (SELECT *, " + RATES + " FROM ("
            + " UNION ALL ".join(rule_numbers(h, r, n) for n, (h, r) in enumerate(zip(HITS, RULES))) + "))")
RULE_PSI = ("(r_test - r_train) * ln(CASE WHEN r_test > 0 THEN r_test ELSE 1e-6 END / CASE WHEN r_train > 0 THEN r_train ELSE 1e-6 END)")


def tagged(spark, folder):
    return mining.mining_split(kept_applications(spark, folder, RULE_COLUMNS), "app_id", "apply_time")


@query("rule_performance", on_app(
    "SELECT rule_id, rule, " + ", ".join(
        f"bad_{p}, total_{p} - bad_{p} AS good_{p}, total_{p}, round(r_{p}, 6) AS bad_rate_{p}, round(r_{p} / (b_{p} / t_{p}), 6) AS lift_{p}, "
        f"round(total_{p} / t_{p}, 6) AS hit_rate_{p}" for p in PARTS)
    + f", round({RULE_PSI}, 6) AS psi, round(r_train / (b_train / t_train) - r_test / (b_test / t_test), 6) AS lift_decay FROM measured",
    TAGGED, MEASURED))
def rule_performance(spark, folder):
    return rounded(mining.rule_performance(tagged(spark, folder), RULES))


@query("rule_recommendations", on_app(
    "SELECT rule, round(r_train, 6) AS train_bad_rate, round(r_train / (b_train / t_train), 6) AS train_lift, "
    "round(total_train / t_train, 6) AS train_hit_rate, round(r_test / (b_test / t_test), 6) AS test_lift, "
    f"round({RULE_PSI}, 6) AS psi FROM measured", TAGGED, MEASURED))
def rule_recommendations(spark, folder):
    return rounded(mining.mining_summary(mining.rule_performance(tagged(spark, folder), RULES)))


def first_met(rules):
    return "CASE " + " ".join(f"WHEN {HITS[n]} THEN {n}" for n in rules) + " END"


def rule_set_sql(condition, order=None, sort_by="test", cut="true"):
    """Figures of a rule set walked rule by rule, one part of the statement for each; a rule stays under ``condition`` on its new rows."""
    listed = (f"SELECT i, rule_id AS n, rule, decay FROM cut_rules JOIN (VALUES {', '.join(f'({i}, {n})' for i, n in enumerate(order, 1))}) l(i, n) ON rule_id = n"
              if order else f"SELECT row_number() OVER (ORDER BY r_{sort_by} DESC, rule_id) AS i, rule_id AS n, rule, decay FROM cut_rules WHERE {cut}")
    parts = [f"cut_rules AS (SELECT *, {RULE_PSI} AS shift, r_train / (b_train / t_train) - r_test / (b_test / t_test) AS decay FROM measured)",
             f"o AS MATERIALIZED ({listed})",
             "hit AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT app_id, label, g, {n} AS n FROM tg WHERE {h}" for n, h in enumerate(HITS)) + ")",
             "whole AS MATERIALIZED (SELECT COUNT(*) AS t, SUM(label) AS b, COUNT(*) FILTER (g = 'train') AS ttr, COUNT(*) FILTER (g = 'test') AS tte FROM tg)",
             "c0 AS MATERIALIZED (SELECT app_id FROM tg WHERE false)"]
    for i in range(1, len(RULES) + 1):
        parts += [f"m{i} AS MATERIALIZED (SELECT app_id, label, g FROM hit JOIN o USING (n) WHERE i = {i} AND app_id NOT IN (SELECT app_id FROM c{i - 1}))",
                  f"k{i} AS MATERIALIZED (SELECT *, ({condition}) AS keep FROM (SELECT {i} AS i, COUNT(*) AS new_total, CAST(COALESCE(SUM(label), 0) AS BIGINT) AS new_bad, "
                  f"COUNT(*) FILTER (g = 'train') AS ntr, COUNT(*) FILTER (g = 'test') AS nte FROM m{i}) CROSS JOIN whole)",
                  f"c{i} AS MATERIALIZED (SELECT app_id FROM c{i - 1} UNION ALL SELECT app_id FROM m{i} WHERE (SELECT keep FROM k{i}))"]
    steps = " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(1, len(RULES) + 1))
    return on_app(f"""
SELECT CAST(row_number() OVER (ORDER BY i) AS INT) AS position, rule, round(decay, 6) AS lift_decay, new_total, new_bad, new_total - new_bad AS new_good,
  cum_total, cum_bad, cum_total - cum_bad AS cum_good, round(cum_bad / cum_total, 6) AS cum_bad_rate, round(cum_total / t, 6) AS cum_hit_rate,
  round((cum_bad / cum_total) / (b / t), 6) AS cum_lift, round((b - cum_bad) / (t - cum_total), 6) AS rest_bad_rate,
  round(((b - cum_bad) / (t - cum_total)) / (b / t), 6) AS rest_lift, round(ctr / ttr, 6) AS train_cum_hit_rate, round(cte / tte, 6) AS test_cum_hit_rate,
  CASE WHEN ctr = 0 THEN 0 WHEN cte > 0 THEN round((cte / tte - ctr / ttr) * ln((cte / tte) / (ctr / ttr)), 6) END AS psi
FROM (SELECT i, rule, decay, new_total, new_bad, CAST(SUM(new_total) OVER w AS BIGINT) AS cum_total, CAST(SUM(new_bad) OVER w AS BIGINT) AS cum_bad,
    SUM(ntr) OVER w AS ctr, SUM(nte) OVER w AS cte, t, b, ttr, tte
  FROM ({steps}) JOIN o USING (i) WHERE keep WINDOW w AS (ORDER BY i ROWS UNBOUNDED PRECEDING))""", TAGGED, MEASURED, *parts)


BAD_RATE_HOLDS = "CASE WHEN new_total > 0 THEN new_bad / new_total ELSE 0 END >= b / t"


def rule_set_of(spark, folder, policy, **settings):
    df = tagged(spark, folder)
    return rounded(mining.rule_set(df, mining.rule_performance(df, RULES), policy, **settings))


@query("rule_set_all", rule_set_sql("true", [5, 3, 0, 1, 4, 2]))
def rule_set_all(spark, folder):
    return rule_set_of(spark, folder, 0, rules=[RULES[n] for n in (5, 3, 0, 1, 4, 2)])


@query("rule_set_new_rows", rule_set_sql("new_total > 0", [1, 4, 0, 3, 5, 2]))
def rule_set_new_rows(spark, folder):
    return rule_set_of(spark, folder, 1, rules=[RULES[n] for n in (1, 4, 0, 3, 5, 2)])


@query("rule_set_new_bads", rule_set_sql("new_bad > 0", sort_by="test", cut="shift <= 0.5"))
def rule_set_new_bads(spark, folder):
    return rule_set_of(spark, folder, 2, sort_by="test", max_psi=0.5)


@query("rule_set_bad_rate", rule_set_sql(BAD_RATE_HOLDS, sort_by="all"))
def rule_set_bad_rate(spark, folder):
    return rule_set_of(spark, folder, 3, sort_by="all")


@query("rule_set_cut_by_decay", rule_set_sql(BAD_RATE_HOLDS, sort_by="train", cut="decay <= 0.2 AND shift <= 0.05"))
def rule_set_cut_by_decay(spark, folder):
    return rule_set_of(spark, folder, 3, sort_by="train", max_decay=0.2, max_psi=0.05)


@query("captured_rows", on_app(
    "SELECT app_id, amount, balance, n_items, qty, avg_disc, rule AS hit_rule FROM (SELECT *, " + first_met(range(len(RULES)))
    + " AS f FROM tg) JOIN measured ON rule_id = f", TAGGED, MEASURED))
def captured_rows(spark, folder):
    return mining.captured(applications(spark, folder, RULE_COLUMNS), RULES, keep=["app_id"])


@query("mined_tree_rules")
def mined_tree_rules(spark, folder):
    app = kept_applications(spark, folder, RULE_COLUMNS)
    return rounded(mining.mining_summary(mining.mine_rules(app, "app_id", time_col="apply_time", kind="dt", features=FEATURES)))


@query("mined_forest_rules")
def mined_forest_rules(spark, folder):
    app = kept_applications(spark, folder, RULE_COLUMNS)
    return rounded(mining.mining_summary(mining.mine_rules(
        app, "app_id", time_col="apply_time", kind="exrf", features=FEATURES)))


RANDOM = {"n_trees": 3, "max_depth": 2, "min_leaf": 100, "max_features": 0.5, "seed": 11}


def random_tree_sql():
    """Statement that splits every node at the drawn thresholds; what is drawn are constants, the ranges are not."""
    count = max(1, int(RANDOM["max_features"] * len(FEATURES)))
    values = " UNION ALL ".join(f"SELECT app_id, {f} AS f, coalesce({c}, -999) AS x FROM app" for f, c in enumerate(FEATURES))
    parts, found = [f"xs AS ({values})"], []
    for t in range(RANDOM["n_trees"]):
        parts.append(f"n{t}_0 AS (SELECT app_id, label AS y, 0 AS node FROM app)")
        for d in range(RANDOM["max_depth"]):
            at, nodes = f"{t}_{d}", range(2 ** d - 1, 2 ** (d + 1) - 1)
            drawn = ", ".join(f"({i}, {f}, {random_trees.number(RANDOM['seed'], t, i, f, 'order')!r}::DOUBLE, {random_trees.number(RANDOM['seed'], t, i, f, 'at')!r}::DOUBLE)"
                              for i in nodes for f in range(len(FEATURES)))
            parts += [
                f"e{at} AS (SELECT node, f, min(x) AS lo, max(x) AS hi FROM n{at} JOIN xs USING (app_id) WHERE node >= {nodes[0]} GROUP BY node, f HAVING min(x) < max(x))",
                f"""o{at} AS (SELECT e.node, e.f, d.o, CASE WHEN lo + u * (hi - lo) < hi THEN lo + u * (hi - lo) ELSE lo END AS cut
  FROM e{at} e JOIN (VALUES {drawn}) d(node, f, o, u) ON e.node = d.node AND e.f = d.f QUALIFY row_number() OVER (PARTITION BY e.node ORDER BY d.o) <= {count})""",
                f"""s{at} AS (SELECT o.node, o.f, o.o, o.cut, count(*) AS n, sum(y) AS bad, count(*) FILTER (x <= cut) AS ln, coalesce(sum(y) FILTER (x <= cut), 0) AS lb
  FROM n{at} JOIN xs USING (app_id) JOIN o{at} o ON o.node = n{at}.node AND o.f = xs.f GROUP BY ALL)""",
                f"""b{at} AS (SELECT *, (lb * lb + (ln - lb) * (ln - lb)) / ln + ((bad - lb) * (bad - lb) + (n - ln - bad + lb) * (n - ln - bad + lb)) / (n - ln) AS purity
  FROM s{at} WHERE least(ln, n - ln) >= {RANDOM["min_leaf"]} AND bad > 0 AND bad < n QUALIFY row_number() OVER (PARTITION BY node ORDER BY purity DESC, o) = 1)""",
                f"""n{t}_{d + 1} AS (SELECT n.app_id, n.y, CASE WHEN b.node IS NULL THEN n.node WHEN xs.x <= b.cut THEN 2 * n.node + 1 ELSE 2 * n.node + 2 END AS node
  FROM n{at} n LEFT JOIN b{at} b ON n.node = b.node LEFT JOIN xs ON xs.app_id = n.app_id AND xs.f = b.f)"""]
            found.append(f"SELECT {t} AS tree, node, f, round(cut, 6) AS cut, n, bad FROM b{at}")
        found.append(f"SELECT {t}, node, NULL, NULL, count(*), sum(y) FROM n{t}_{RANDOM['max_depth']} GROUP BY node")
    names = "[" + ", ".join(f"'{f}'" for f in FEATURES) + "]"
    return on_app(f"SELECT CAST(tree AS INT) AS tree, CAST(node AS INT) AS node, {names}[f + 1] AS feature, cut, CAST(n AS BIGINT) AS n, CAST(bad AS BIGINT) AS bad "
                  f"FROM ({' UNION ALL '.join(found)})", *parts)


@query("random_tree_nodes", random_tree_sql())
def random_tree_nodes(spark, folder):
    app = kept_applications(spark, folder, [*FEATURES, "label"])
    trees = random_trees.fit(app, FEATURES, bootstrap=False, **RANDOM)
    rows = [(t, i, *((FEATURES[tree.splits[i][0]], float(tree.splits[i][1])) if i in tree.splits else (None, None)), *size)
            for t, tree in enumerate(trees) for i, size in tree.sizes.items()]
    return rounded(spark.createDataFrame(rows, "tree int, node int, feature string, cut double, n bigint, bad bigint"))


# ---------------------------------------------------------------- monitoring

def edge(i, n, low="lo", high="hi"):
    """Edge number ``i`` of ``n`` bins of equal width."""
    return f"(CASE WHEN {i} = {n} THEN {high} ELSE {i} * (({high} - {low}) / {n}) + {low} END)"


def equal_bin(n):
    """Left-closed bin of ``score`` between ``lo`` and ``hi``, the outer ones open."""
    return f"greatest(least(len(list_filter(range(0, {n + 1}), lambda i: {edge('i', n)} <= score)), {n}), 1)"


@query("monitor_batch", on_app(
    f"""SELECT 'oot' AS batch_name, sample_size, psi, avg_score, min_score, max_score, std_score, CAST(b AS INT) AS bin, COUNT(score) AS n,
      round({edge('(b - 1)', 10, 'any_value(lo)', 'any_value(hi)')}, 6) AS low, round({edge('b', 10, 'any_value(lo)', 'any_value(hi)')}, 6) AS high
    FROM (SELECT unnest(range(1, 11)) AS b) CROSS JOIN figures CROSS JOIN shift
    LEFT JOIN (SELECT score, {equal_bin(10)} AS bin FROM batch, figures) ON bin = b
    GROUP BY b, sample_size, psi, avg_score, min_score, max_score, std_score""", SCORED,
    "batch AS (SELECT score FROM scored WHERE target = 'oot')",
    "figures AS (SELECT COUNT(*) AS sample_size, round(avg(score), 6) AS avg_score, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, "
    "round(stddev_pop(score), 6) AS std_score, min(score) AS lo, max(score) AS hi FROM batch)",
    "ends AS (SELECT min(score) AS lo, max(score) AS hi FROM scored WHERE target = 'train')",
    f"""shift AS (SELECT round(SUM((ap - xp) * ln(ap / xp)), 6) AS psi FROM (
      SELECT CASE WHEN x = 0 THEN 1e-6 ELSE x / SUM(x) OVER () END AS xp, CASE WHEN a = 0 THEN 1e-6 ELSE a / SUM(a) OVER () END AS ap
      FROM (SELECT b, COUNT(*) FILTER (target = 'train') AS x, COUNT(*) FILTER (target = 'oot') AS a
        FROM (SELECT unnest(range(1, 21)) AS b) LEFT JOIN (SELECT target, {equal_bin(20)} AS bin FROM scored, ends) ON bin = b GROUP BY b)))"""))
def monitor_batch(spark, folder):
    app = scored(spark, folder, ["label", "target"])
    stored = evaluate.score_distribution(app.where(F.col("target") == "train")).first().asDict()
    one = monitor.monitor_scores(app.where(F.col("target") == "oot"), stored, batch_name="oot")
    return rounded(one.select("*", F.posexplode("counts").alias("i", "n")).select(
        "batch_name", "sample_size", "psi", "avg_score", "min_score", "max_score", "std_score", (F.col("i") + 1).cast("int").alias("bin"), "n",
        F.get("bins", F.col("i")).alias("low"), F.get("bins", F.col("i") + 1).alias("high")))


@query("monitor_model")
def monitor_model(spark, folder):
    app = kept_applications(spark, folder, MODEL_COLUMNS)
    model, _ = train.train_scorecard(app, FITTED, n_trials=1, space={"C": ("log", 0.4, 0.5), "maxIter": ("int", 20, 20)})
    return rounded(monitor.monitor_model(model, app.where(F.col("target") == "oot"), "oot").drop("bins", "counts"))


NODE_COLUMNS = ("node", "id", "name", "rule_type", "node_input_count", "intercept_count", "pass_count", "node_intercept_rate",
                "node_pass_rate", "global_intercept_rate", "global_pass_rate")


def log_rows(summary, nodes, columns=NODE_COLUMNS):
    """Statement of a log row with its nodes, one line per node, whose figures are named ``node_...``."""
    named = ", ".join(f"n.{c} AS node_{c}" for c in columns)
    return f"SELECT 'whole book' AS batch_name, s.*, {named} FROM ({STATEMENTS[summary]}) s CROSS JOIN ({STATEMENTS[nodes]}) n"


def per_node(logged):
    exploded = logged.select("*", F.explode("nodes").alias("_n"))
    return exploded.select(*[c for c in logged.columns if c != "nodes"], *[F.col(f"_n.{c}").alias(f"node_{c}") for c in exploded.schema["_n"].dataType.names])


@query("monitor_strategies", log_rows("flow_summary", "flow_nodes"))
def monitor_strategies(spark, folder):
    return per_node(monitor.monitor_strategies(applications(spark, folder, COLUMNS), BASELINE, batch_name="whole book"))


@query("monitor_comparison", log_rows("flow_comparison", "flow_comparison_nodes", ("flow", *NODE_COLUMNS)))
def monitor_comparison(spark, folder):
    return per_node(monitor.monitor_comparison(applications(spark, folder, COLUMNS), BASELINE, EXPERIMENT, batch_name="whole book"))


MONTH_LOGS = (
    SCORED, "mq AS (SELECT quantile_cont(proba, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS cuts FROM app WHERE target = 'train')",
    "mc AS (SELECT month_time, bin, COALESCE(n, 0) AS n, SUM(COALESCE(n, 0)) OVER (PARTITION BY month_time) AS t FROM "
    "(SELECT month_time, unnest(range(1, 11)) AS bin FROM (SELECT DISTINCT month_time FROM app)) LEFT JOIN (SELECT month_time, "
    "1 + len(list_filter(cuts, lambda c: c < proba)) AS bin, COUNT(*) AS n FROM app, mq GROUP BY ALL) USING (month_time, bin))",
    "ml AS (SELECT m.month_time, SUM((greatest(m.n / m.t, 1e-6) - greatest(b.n / b.t, 1e-6)) * ln(greatest(m.n / m.t, 1e-6) / greatest(b.n / b.t, 1e-6))) AS psi "
    "FROM mc m JOIN mc b ON m.bin = b.bin AND b.month_time = (SELECT min(month_time) FROM app) GROUP BY m.month_time)")


@query("recent_logs", on_app(
    "SELECT month_time AS batch_name, round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi > 0.25 THEN 'unstable' ELSE 'attention' END "
    "AS band FROM ml ORDER BY month_time DESC LIMIT 20", *MONTH_LOGS))
def recent_logs(spark, folder):
    months = psi.report_month_psi(kept_applications(spark, folder, ["proba", "target", "month_time"]))
    logs = months.select(F.col("month").alias("batch_name"), "psi", F.to_timestamp("month", "yyyy-MM").alias("created_at"))
    return rounded(monitor.recent_logs(logs, 20).select("batch_name", "psi", "band"))


@query("psi_trend", on_app(
    "SELECT month_time AS batch_name, round(psi, 6) AS psi, round(psi - lag(psi) OVER (ORDER BY month_time), 6) AS psi_change "
    "FROM (SELECT * FROM ml ORDER BY month_time DESC LIMIT 10)", *MONTH_LOGS))
def psi_trend(spark, folder):
    months = psi.report_month_psi(kept_applications(spark, folder, ["proba", "target", "month_time"]))
    logs = months.select(F.col("month").alias("batch_name"), "psi", F.to_timestamp("month", "yyyy-MM").alias("created_at"))
    return rounded(monitor.psi_trend(logs, 10).select("batch_name", "psi", "psi_change"))


def drift_sql(body, closed="true"):
    """Statement over ``shifts``: PSI and rows of every 7-day window under ``closed``."""
    return f"""
WITH ends AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
b AS (SELECT ts, time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01') AS w, greatest(least(len(list_filter(range(0, 11), lambda i:
    (CASE WHEN i = 10 THEN hi ELSE i * ((hi - lo) / 10) + lo END) <= value)), 10), 1) AS bin FROM events, ends WHERE value IS NOT NULL),
x AS (SELECT bin, COUNT(*) / SUM(COUNT(*)) OVER () AS e FROM b GROUP BY bin),
a AS (SELECT d.w, d.bin, COALESCE(n, 0) AS n, COALESCE(n, 0) / SUM(COALESCE(n, 0)) OVER (PARTITION BY d.w) AS s FROM
  (SELECT DISTINCT w, unnest(range(1, 11)) AS bin FROM b) d LEFT JOIN (SELECT w, bin, COUNT(*) AS n FROM b GROUP BY ALL) c
  ON c.w = d.w AND c.bin = d.bin),
shifts AS (SELECT strftime(w, '%Y-%m-%d') AS window_start, SUM((CASE WHEN s = 0 THEN 1e-6 ELSE s END - COALESCE(e, 1e-6))
  * ln(CASE WHEN s = 0 THEN 1e-6 ELSE s END / COALESCE(e, 1e-6))) AS psi, CAST(SUM(n) AS BIGINT) AS n
  FROM a LEFT JOIN x USING (bin) WHERE {closed} GROUP BY w)
{body}"""


def event_counts(spark, folder, late):
    """Windowed counts of the stream of events, and the rows of the whole table per bin."""
    table = spark.read.parquet(f"{folder}/events.parquet")
    edges = binning.equal_width_edges(table, ["value"], 10)["value"]
    base = binning.bin_counts(table, {"value": edges}, None, closed="left_highest", missing=None).collect()
    sizes = {r["bin"]: r["total"] for r in base}
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return drift.windowed_counts(stream, "ts", "value", edges, "7 days", late), [sizes.get(b, 0) for b in range(1, 11)]


@query("stream_drift", drift_sql("SELECT window_start, round(psi, 6) AS psi, n FROM shifts"))
def stream_drift(spark, folder):
    counts, baseline = event_counts(spark, folder, "7 days")
    place = new_place(spark, "stream")
    drift.start_counting(counts, f"{place}/counts", f"{place}/checkpoint", availableNow=True).awaitTermination()
    result = drift.window_psi(drift.newest_counts(spark, f"{place}/counts"), baseline)
    return rounded(result.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")))


@query("stream_closed_windows", drift_sql("""
SELECT window_start, round(psi, 6) AS psi, n, band, lag(band) OVER o AS band_before, COALESCE(band <> lag(band) OVER o, false) AS changed
FROM (SELECT *, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi > 0.25 THEN 'unstable' ELSE 'attention' END AS band FROM shifts)
WINDOW o AS (ORDER BY window_start)""", "w + INTERVAL 7 DAYS <= (SELECT max(ts) - INTERVAL 1 DAY FROM b)"))
def stream_closed_windows(spark, folder):
    """Bands of the windows that the watermark, a day behind the newest event, has passed."""
    counts, baseline = event_counts(spark, folder, "1 day")
    place = new_place(spark, "stream")
    drift.start_closing(counts, f"{place}/closed", f"{place}/checkpoint", availableNow=True).awaitTermination()
    result = drift.band_changes(drift.window_psi(spark.read.parquet(f"{place}/closed"), baseline))
    return rounded(result.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")))
