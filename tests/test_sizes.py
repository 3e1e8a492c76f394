"""Results don't depend on how many rows or columns there are: paths for small and large inputs agree to the last bit."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendgauge.operators import screen
from lendgauge.operators.ranks import quantiles
from lendgauge.operators.screen import correlation_pairs
from lendgauge.operators.split import tag_oot_by_share

DECILES = [i / 10 for i in range(1, 10)]


@pytest.mark.parametrize("n", [1331, 1381, 1001])
def test_quantiles_are_the_same_on_both_paths(spark, n, monkeypatch):
    rng = random.Random(n)
    rows = [(round(rng.uniform(0, 5e5), 2), float(rng.randrange(7)), None if i % 3 else 0.1 * i) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double").cache()
    small = quantiles(df, ["a", "b", "c"], DECILES)
    assert quantiles(df, ["a", "b", "c"], DECILES, small_group=50) == small
    monkeypatch.setattr("lendgauge.operators.ranks.TASK_VALUES", n)
    assert quantiles(df, ["a", "b", "c"], DECILES) == small


def test_text_keys_order_rows_of_one_time(spark):
    df = spark.range(600).select(F.concat(F.lit("loan-"), "id").alias("key"), F.lit(202001).alias("month")).cache()
    tags = [{r.key: r.split for r in tag_oot_by_share(df, "month", "key", 0.2, small_group=s).collect()} for s in (1_000_000, 20)]
    assert tags[0] == tags[1] and sum(t == "oot" for t in tags[0].values()) == 120


@pytest.mark.parametrize("pair_sums", [1, 25, 64])
def test_strips_give_the_pairs_of_one_scan(spark, pair_sums):
    rng = np.random.default_rng(pair_sums)
    rows = [[None if v < -1.5 else float("nan") if v > 1.8 else float(v) for v in row] for row in rng.normal(size=(300, 12))]
    df = spark.createDataFrame(rows, ", ".join(f"x{i} double" for i in range(12))).repartition(5)
    assert len(list(screen._strips(12, pair_sums))) > 1
    whole, strips = [{(r.feature_a, r.feature_b): r.corr for r in correlation_pairs(df, pair_sums=n).collect()} for n in (1 << 22, pair_sums)]
    assert len(whole) == 66 and whole.keys() == strips.keys()
    for pair, corr in whole.items():
        assert abs(strips[pair] - corr) < 1e-12
    none = correlation_pairs(df.where("false"), pair_sums=pair_sums).collect()
    assert len(none) == 66 and all(r.corr is None for r in none)


def test_thousand_columns_drop_what_all_pairs_drop(spark):
    width, rng = 1000, np.random.default_rng(5)
    base = rng.normal(size=(80, width // 4))
    values = np.hstack([base + noise * rng.normal(size=base.shape) for noise in (0, 0.1, 0.5, 3)])
    names = [f"x{i}" for i in range(width)]
    df = spark.createDataFrame([(row.tolist(),) for row in values], "v array<double>").select(*[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names)])
    strength = rng.random(width)
    iv = spark.createDataFrame(list(zip(names, strength.tolist())), "feature string, iv double")
    got = {r.feature for r in screen.correlation_prune(correlation_pairs(df, names, pair_sums=1 << 18), iv, 0.9).collect()}
    a, b = np.nonzero(np.triu(np.abs(np.corrcoef(values.T)) >= 0.9, 1))
    assert got == {names[j if strength[i] >= strength[j] else i] for i, j in zip(a, b)} and len(got) > 200


@pytest.mark.parametrize("width", [3, 30])
def test_one_correlation_per_pair(spark, width):
    rng = np.random.default_rng(width)
    values = rng.normal(size=(200, width))
    values[:, 1] = 2 * values[:, 0]
    values[5, 0] = np.nan
    rows = [tuple(float(v) for v in row) + (None,) for row in values]
    names = [f"x{i}" for i in range(width)] + ["empty"]
    got = {(r.feature_a, r.feature_b): r.corr for r in correlation_pairs(
        spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)), names).collect()}
    assert len(got) == (width + 1) * width // 2
    assert abs(got["x0", "x1"] - 1) < 1e-12 and got["x0", "empty"] is None
    known = np.delete(values, 5, 0)
    assert abs(got["x0", "x2"] - np.corrcoef(known[:, 0], known[:, 2])[0, 1]) < 1e-9
