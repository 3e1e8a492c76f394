import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendgauge.operators import spans
from lendgauge.session import new_place

SCHEMA = "day string, x double, n long, word string"


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    made = [(f"d{draw.randrange(6)}", draw.gauss(1e6, 1.0), draw.randrange(3000), f"w{draw.randrange(200)}") for _ in range(20000)]
    odd = [("d0", None, None, None), (None, float("nan"), 1 << 60, ""), ("d1", 0.0, (1 << 60) + 1, "w1"), ("d1", -0.0, 1, "w1"), ("d9", None, None, None)]
    return made + odd


def merged_figures(profiles):
    return {r.column_name: r for r in spans.span_figures(spans.merge_profiles(profiles), (0.1, 0.5, 0.9)).collect()}


def check(figures, rows):
    for at, name in ((1, "x"), (2, "n"), (3, "word")):
        values = [r[at] for r in rows if r[at] is not None and r[at] == r[at]]
        found = figures[name]
        assert (found.n_rows, found.n_missing) == (len(rows), len(rows) - len(values))
        exact = len(set(values))
        assert abs(found.n_distinct - exact) <= max(found.distinct_error * exact, 1)
        if name == "word":
            assert found["mean"] is None and found.q50 is None and found.low is None
            continue
        data = np.sort(np.array(values, float))
        assert (found.low, found.high) == (data[0], data[-1])
        assert math.isclose(found["mean"], data.mean(), rel_tol=1e-9) and math.isclose(found["std"], data.std(ddof=1), rel_tol=1e-6)
        for p in (0.1, 0.5, 0.9):
            low, high = np.searchsorted(data, found[f"q{round(p * 100)}"], "left"), np.searchsorted(data, found[f"q{round(p * 100)}"], "right")
            # Twice the bound: it holds for one rank in 99 of 100 cases.
            assert low / len(data) - 2 * found.rank_error <= p <= high / len(data) + 2 * found.rank_error


def test_merged_batches_describe_all_their_rows(spark, rows):
    profiles = spans.batch_profiles(spark.createDataFrame(rows, SCHEMA), "day")
    assert profiles.count() == 3 * len({r[0] for r in rows})
    check(merged_figures(profiles), rows)
    span = ["d1", "d3"]
    check(merged_figures(profiles.where(F.col("batch").isin(span))), [r for r in rows if r[0] in span])


def test_merged_equals_one_pass_and_any_order(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    by_day = spans.batch_profiles(df, "day").cache()
    whole = spans.batch_profiles(df.withColumn("day", F.lit("all")), "day")
    a, b = merged_figures(by_day), merged_figures(whole)
    turned = merged_figures(by_day.repartition(3).orderBy(F.desc("batch")))
    for name in a:
        for c in ("n_rows", "n_missing", "low", "high", "n_distinct"):
            assert a[name][c] == turned[name][c]
        for c in ("n_rows", "n_missing", "low", "high"):
            assert a[name][c] == b[name][c]


def test_a_batch_stored_again_replaces_its_rows(spark, rows):
    path = new_place(spark, "profiles")
    df = spark.createDataFrame(rows, SCHEMA)
    spans.store_profiles(spans.batch_profiles(df.where("day <> 'd2'"), "day"), path)
    spans.store_profiles(spans.batch_profiles(df.where("day = 'd2'").limit(10), "day"), path)
    spans.store_profiles(spans.batch_profiles(df.where("day = 'd2'"), "day"), path)
    spans.store_profiles(spans.batch_profiles(df.where("day is null"), "day"), path)
    stored = spans.stored_profiles(spark, path)
    check(merged_figures(stored), rows)
    one = stored.where("batch = 'd2'")
    check(merged_figures(one), [r for r in rows if r[0] == "d2"])
    assert "PartitionFilters: [isnotnull(batch" in one._jdf.queryExecution().toString()


def test_no_rows_and_columns_without_values(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert spans.batch_profiles(df.where("false"), "day").count() == 0
    nothing = merged_figures(spans.batch_profiles(df.where("day = 'd9'"), "day"))
    assert all((r.n_rows, r.n_missing, r.n_distinct, r["mean"], r["std"], r.q50) == (1, 1, 0, None, None, None) for r in nothing.values())


def test_psi_of_spans_is_near_the_exact_one(spark):
    draw = np.random.default_rng(3)
    a, b = draw.normal(0, 1, 30000), draw.normal(0.4, 1.2, 20000)
    rows = [("a", float(v), 1.0) for v in a] + [("b", float(v), 1.0) for v in b] + [("c", None, None)]
    profiles = spans.batch_profiles(spark.createDataFrame(rows, "part string, x double, same double"), "part").cache()
    of = lambda *names: spans.merge_profiles(profiles.where(F.col("batch").isin(*names)))
    cuts = np.quantile(a, np.linspace(0, 1, 11)[1:-1])
    share = lambda v: np.diff(np.concatenate(([0], np.searchsorted(np.sort(v), cuts, "right"), [len(v)]))) / len(v)
    e, s = share(a), share(b)
    found = {r.column_name: r.psi for r in spans.span_psi(of("a"), of("b", "c")).collect()}
    assert abs(found["x"] - float(((s - e) * np.log(s / e)).sum())) < 0.03 and abs(found["same"]) < 1e-6
    assert {r.psi for r in spans.span_psi(of("a"), of("c")).collect()} == {0.0}
    same = {r.column_name: r.psi for r in spans.span_psi(of("a"), of("a")).collect()}
    assert same["x"] < 1e-3
