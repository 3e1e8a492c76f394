import numpy as np
import pytest
from pyspark.sql import functions as F

from lendgauge.operators import ranks
from lendgauge.operators.ranks import order_statistics, quantiles, running_totals

SHARES = [0.0, 0.05, 0.1, 1 / 3, 0.5, 0.75, 0.9, 0.999, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value, one group holds most rows, some values are missing."""
    generator = np.random.default_rng(3)
    x = generator.normal(0, 1, 6000).round(3)
    x[::3] = 0.25
    rows = [("big" if i % 10 else "small", float(v) if i % 17 else None) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "g string, x double").cache(), rows


@pytest.mark.parametrize("small_group", [1_000_000, 200])
def test_quantiles_match_numpy(skewed, small_group):
    df, rows = skewed
    found = quantiles(df, ["x"], SHARES, ["g"], small_group)
    for g in ("big", "small"):
        values = [v for k, v in rows if k == g and v is not None]
        assert np.allclose(found[(g,)]["x"], np.quantile(values, SHARES), atol=1e-12)


def test_quantiles_of_empty_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert quantiles(df, ["a", "b"], [0.5])[()] == {"a": [1.5], "b": None}


@pytest.mark.parametrize("small_group", [1_000_000, 10])
def test_ranks_of_large_integers_stay_exact(spark, small_group):
    values = [2 ** 62 + 3 * i for i in range(400)] + [2 ** 62 + 300] * 200
    df = spark.createDataFrame([(v,) for v in values], "x long")
    expected = sorted(values)
    ranks = [0, 99, 100, 250, 599]
    found = order_statistics(df, "x", {(): ranks}, (), small_group)[()]
    assert [found[r] for r in ranks] == [expected[r] for r in ranks]


@pytest.mark.parametrize("small_group", [1_000_000, 20])
def test_running_totals(spark, small_group):
    generator = np.random.default_rng(5)
    data = {("a", float(v)): int(generator.integers(1, 9)) for v in generator.normal(0, 1, 700)}
    data.update({("b", float(v)): 1 for v in range(30)})
    df = spark.createDataFrame([(*k, n) for k, n in data.items()], "g string, x double, n long")
    rows = running_totals(df, ["g"], "x", ["n"], small_group).collect()
    assert len(rows) == len(data)
    for g in ("a", "b"):
        total = 0
        for r in sorted((r for r in rows if r["g"] == g), key=lambda r: r["x"]):
            total += r["n"]
            assert r["cum_n"] == total


def test_sketch_never_decides_the_result(spark):
    df = spark.range(5000).select((F.col("id") % 7).cast("double").alias("x"))
    assert quantiles(df, ["x"], [0.5, 0.9], (), 10)[()]["x"] == [3.0, 6.0]


def refused(*args, **kwargs):
    raise AssertionError("many ranks of a large group are not found this way")


@pytest.mark.parametrize("small_group", [1_000_000, 50])
def test_many_quantiles_come_from_running_counts(spark, monkeypatch, small_group):
    """No task walks all values per probability, and no row is compared with all wanted ranks."""
    generator = np.random.default_rng(7)
    values = {"x": generator.normal(0, 1, 5000).round(2), "y": np.where(np.arange(5000) % 3, 4.0, generator.random(5000))}
    groups = [("a", None)[i % 2] for i in range(5000)]
    df = spark.createDataFrame([(g, float(x), float(y), None) for g, x, y in zip(groups, values["x"], values["y"])], "g string, x double, y double, z double")
    shares = [i / 255 for i in range(1, 255)]
    monkeypatch.setattr(ranks, "TASK_STEPS", 1000)
    for name in ("_quantiles_in_memory", "order_statistics"):
        monkeypatch.setattr(ranks, name, refused)
    found = quantiles(df, ["x", "y", "z"], shares, ["g"], small_group)
    for g in ("a", None):
        own = np.array([k == g for k in groups])
        for c in ("x", "y"):
            assert np.allclose(found[(g,)][c], np.quantile(values[c][own], shares), atol=1e-12)
        assert found[(g,)]["z"] is None


@pytest.mark.parametrize("small_group", [1_000_000, 40])
def test_only_values_near_wanted_ranks_are_ordered(spark, monkeypatch, small_group):
    """Running totals of all distinct values aren't needed for a few ranks; NaN comes last, both zeros are one value."""
    generator = np.random.default_rng(11)
    x = generator.normal(0, 1, 3000).round(2)
    x[:900], x[900:903] = 0.0, float("nan")
    df = spark.createDataFrame([("a" if i % 3 else None, float(-v if i % 2 and v == 0 else v)) for i, v in enumerate(x)], "g string, x double")
    monkeypatch.setattr(ranks, "TASK_STEPS", 1000)
    monkeypatch.setattr(ranks, "running_totals", refused)
    found = quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.99, 1.0], ["g"], small_group)
    for g in ("a", None):
        own = np.sort(np.where(np.isnan(x), np.inf, x)[[(i % 3 > 0) == (g == "a") for i in range(3000)]])
        assert np.allclose(found[(g,)]["x"][:4], np.quantile(own, [0.0, 0.25, 0.5, 0.99]), atol=1e-12)
        assert np.isnan(found[(g,)]["x"][4])
