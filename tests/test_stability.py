import numpy as np
import pytest
from pyspark.sql import functions as F

from lendgauge.operators import psi, screen
from lendgauge.streaming import drift


def numpy_psi(expected, actual, edges):
    e, a = np.histogram(expected, edges)[0] / len(expected), np.histogram(actual, edges)[0] / len(actual)
    e, a = np.where(e == 0, 1e-6, e), np.where(a == 0, 1e-6, a)
    return float(((a - e) * np.log(a / e)).sum())


@pytest.fixture(scope="module")
def two_sides(spark):
    generator = np.random.default_rng(9)
    a, b = generator.normal(0, 1, 1000), generator.normal(0, 2, 1000)
    rows = [(float(v), "e") for v in a] + [(float(v), "a") for v in b]
    return spark.createDataFrame(rows, "x double, side string").cache(), a, b


def sides():
    return F.col("side") == "e", F.col("side") == "a"


def test_psi_matches_histograms(two_sides):
    df, a, b = two_sides
    both = np.hstack([a, b])
    width = psi.psi_between(df, ["x"], *sides()).first()["psi"]
    assert width == pytest.approx(numpy_psi(a, b, np.linspace(both.min(), both.max(), 11)))
    frequency = psi.psi_between(df, ["x"], *sides(), method="equal_frequency").first()["psi"]
    assert frequency == pytest.approx(numpy_psi(a, b, np.unique(np.percentile(both, np.linspace(0, 100, 11)))))


def test_psi_of_itself_is_zero_and_symmetric(two_sides):
    df, _, _ = two_sides
    every = F.lit(True)
    assert psi.psi_between(df, ["x"], every, every).first()["psi"] == 0
    e, a = sides()
    assert psi.psi_between(df, ["x"], e, a).first()["psi"] == pytest.approx(psi.psi_between(df, ["x"], a, e).first()["psi"])


def test_detail_of_constant_base_and_text(spark):
    df = spark.createDataFrame([(1.0, "e", "t"), (1.0, "e", "t"), (2.0, "a", "t")], "x double, side string, s string")
    assert psi.psi_detail(df, "x", *sides()).first()["psi"] == 999999
    assert psi.psi_between(df.withColumn("x", F.lit(1.0)), ["x"], *sides()).first()["psi"] == 0
    with pytest.raises(TypeError):
        psi.psi_detail(df, "s", *sides())


def test_detail_counts_smallest_value_and_empty_bins(spark):
    df = spark.createDataFrame([(0.0, "e"), (10.0, "e"), (0.0, "a"), (0.5, "a")], "x double, side string")
    rows = {r["bin"]: r for r in psi.psi_detail(df, "x", *sides(), bins=5).collect()}
    assert len(rows) == 6 and rows[1]["expected"] == 1 and rows[1]["actual"] == 2 and rows[3]["expected"] == 0
    assert rows[0]["expected"] == 2 and rows[0]["psi"] == pytest.approx(sum(r["psi"] for b, r in rows.items() if b))


@pytest.mark.parametrize("method", ["equal_width", "equal_frequency"])
def test_month_psi_matches_pairs(spark, method):
    generator = np.random.default_rng(2)
    months = {"2024-01": generator.normal(0, 1, 200), "2024-02": generator.normal(0.5, 1, 150), "2024-03": np.full(20, 0.1)}
    df = spark.createDataFrame([(m, float(v)) for m, vs in months.items() for v in vs], "month_time string, x double")
    found = {r["month"]: r["psi"] for r in psi.month_psi(df, "x", method=method).collect()}
    base = months["2024-01"]
    for m, values in months.items():
        both = np.hstack([values, base])
        edges = (np.linspace(both.min(), both.max(), 11) if method == "equal_width"
                 else np.unique(np.percentile(both, np.linspace(0, 100, 11))))
        assert found[m] == pytest.approx(numpy_psi(base, values, edges), abs=1e-9), m


def test_one_month_gives_no_monthly_report(app):
    assert psi.report_month_psi(app.withColumn("month_time", F.lit("2024-01"))).count() == 0


def test_stability_bands(spark):
    df = spark.createDataFrame([(0.05,), (0.1,), (0.25,), (0.3,), (None,)], "psi double")
    assert [r[0] for r in df.select(psi.stability_band("psi")).collect()] == [
        "stable", "attention", "attention", "unstable", None]


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    rows = [(f"2024-01-{d:02d} 10:00:00", float(d % 5)) for d in range(1, 29) for _ in range(d)]
    table = spark.createDataFrame(rows, "t string, score double").select(F.to_timestamp("t").alias("ts"), "score")
    source = str(tmp_path / "in")
    table.repartition(3).write.parquet(source)
    edges = [0.0, 1.5, 3.0, 4.0]
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(source)
    counts = drift.windowed_counts(stream, "ts", "score", edges, "7 days", "60 days")
    out = str(tmp_path / "counts")
    drift.start_counting(counts, out, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
    streamed = {(r["window_start"], r["bin"]): r["n"] for r in drift.newest_counts(spark, out).collect()}
    batch = {(r["window_start"], r["bin"]): r["n"] for r in drift.windowed_counts(table, "ts", "score", edges, "7 days").collect()}
    assert streamed == batch and sum(batch.values()) == len(rows)
    shifts = drift.window_psi(drift.newest_counts(spark, out), [10, 10, 10]).collect()
    assert len(shifts) == len({w for w, _ in batch}) and all(r["psi"] >= 0 for r in shifts)


def days(spark, *rows):
    return spark.createDataFrame([(f"2024-{d} 10:00:00", s) for d, s in rows], "t string, score double").select(F.to_timestamp("t").alias("ts"), "score")


def test_closed_windows_come_once_without_late_rows(spark, tmp_path):
    source, closed, place = (str(tmp_path / name) for name in ("in", "closed", "checkpoint"))
    first = days(spark, ("01-01", 1.0), ("01-02", 2.0), ("01-08", 1.0), ("01-20", 3.0), ("01-20", None))

    def run():
        stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(source)
        counts = drift.windowed_counts(stream, "ts", "score", [0.0, 1.5, 3.0, 4.0], "7 days", "2 days")
        drift.start_closing(counts, closed, place, availableNow=True).awaitTermination()
        return sorted((str(r["window_start"])[:10], r["bin"], r["n"]) for r in spark.read.parquet(closed).collect())

    first.coalesce(1).write.parquet(source)
    # Weeks begin on Thursdays; the newest row is of the 20th, so weeks that end by the 18th are closed.
    begun = [("2023-12-28", 1, 1), ("2023-12-28", 2, 1), ("2024-01-04", 1, 1)]
    assert run() == begun and run() == begun
    # The first row is too late, the second not.
    days(spark, ("01-05", 1.0), ("01-19", 1.0)).coalesce(1).write.mode("append").parquet(source)
    assert run() == begun
    days(spark, ("02-20", 1.0)).coalesce(1).write.mode("append").parquet(source)
    assert run() == [*begun, ("2024-01-18", 1, 1), ("2024-01-18", 3, 1)]


def test_a_repeated_micro_batch_counts_once_and_old_tables_go(spark, tmp_path):
    folder = str(tmp_path / "counts")
    batch = lambda *rows: spark.createDataFrame(rows, "window_start string, bin int, n long")
    newest = lambda: sorted(tuple(r) for r in drift.newest_counts(spark, folder).collect())
    assert drift.generations(spark, folder) == []
    drift.merge_counts(batch(("a", 1, 5), ("a", 2, 1)), 0, folder)
    for _ in range(2):
        drift.merge_counts(batch(("a", 1, 7), ("b", 1, 2)), 1, folder)
        assert newest() == [("a", 1, 7), ("a", 2, 1), ("b", 1, 2)]
    for number in range(2, 6):
        drift.merge_counts(batch(("b", 1, number)), number, folder)
    assert newest() == [("a", 1, 7), ("a", 2, 1), ("b", 1, 5)] and drift.generations(spark, folder) == [4, 5]
    # Written only in part: the one before counts.
    (tmp_path / "counts" / "counts-6").mkdir()
    assert newest()[-1] == ("b", 1, 5)


def test_band_changes(spark):
    shifts = spark.createDataFrame([("a", 0.05), ("b", 0.2), ("c", 0.2), ("d", 0.3)], "window_start string, psi double")
    assert [(r["band_before"], r["changed"]) for r in drift.band_changes(shifts).orderBy("window_start").collect()] == [
        (None, False), ("stable", True), ("attention", False), ("attention", True)]


# ---------------------------------------------------------------- screening

def test_screen_order_and_text_majority(spark):
    rows = [(1.0, None if i < 96 else 1.0, "a" if i < 96 else str(i), float(i), "a" if i % 2 else "b") for i in range(100)]
    df = spark.createDataFrame(rows, "same double, empty double, mostly string, free double, half string")
    found = {r["column_name"]: r["reason"] for r in screen.screen_basic(df, df.columns).collect()}
    assert found == {"same": "freq", "empty": "missing", "mostly": "freq", "free": None, "half": None}
    low = {r["column_name"]: r["reason"] for r in screen.screen_basic(df, ["half", "free"], freq_limit=0.4).collect()}
    assert low == {"half": "freq", "free": None}
    filled = df.fillna(-999.0, ["empty"])
    assert screen.screen_basic(filled, ["empty"], impute_value=-999.0).first()["reason"] == "missing"


def test_dominating_text_is_found_without_counting_all_values(spark, monkeypatch):
    """The hash of the median text is the same number before and after the sketch."""
    def refused(*args, **kwargs):
        raise AssertionError("all values are counted")

    texts = [f"text {i}" for i in range(40)]
    df = spark.createDataFrame([(*(t if i % 50 else "rare" for t in texts), None) for i in range(400)],
                               ", ".join(f"c{i} string" for i in range(40)) + ", none string")
    monkeypatch.setattr(screen, "top_share", refused)
    found = {r["column_name"]: r["reason"] for r in screen.screen_basic(df, df.columns).collect()}
    assert found == {**{f"c{i}": "freq" for i in range(40)}, "none": "missing"}


def test_correlation_agrees_with_pandas(spark):
    generator = np.random.default_rng(4)
    base = generator.normal(1e6, 1, (400, 7))
    base[:, 1] = base[:, 0] * 2 + 1
    rows = [[float(v) if generator.random() > 0.1 else None for v in row] for row in base]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(7))).withColumn("k", F.lit(3.0))
    expected = df.toPandas().corr()
    found = screen.correlation_pairs(df, df.columns).collect()
    assert len(found) == 28
    for r in found:
        if r["feature_b"] == "k":
            assert r["corr"] is None
        else:
            assert r["corr"] == pytest.approx(expected.loc[r["feature_a"], r["feature_b"]], abs=1e-6)


def test_prune_counts_dropped_features_too(spark):
    pairs = spark.createDataFrame([("a", "b", 0.95), ("b", "c", -0.95), ("a", "c", 0.1)], "feature_a string, feature_b string, corr double")
    iv = spark.createDataFrame([("a", 0.3), ("b", 0.2), ("c", 0.1)], "feature string, iv double")
    assert {r["feature"] for r in screen.correlation_prune(pairs, iv).collect()} == {"b", "c"}
    ties = spark.createDataFrame([("a", 0.2), ("b", 0.2), ("c", 0.2)], "feature string, iv double")
    assert {r["feature"] for r in screen.correlation_prune(pairs, ties).collect()} == {"b", "c"}
