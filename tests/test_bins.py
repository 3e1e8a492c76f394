import math
import random
import tracemalloc
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lendgauge.functions.bins import INF, bin_number, equal_width, with_infinite_ends
from lendgauge.functions import in_task
from lendgauge.operators import binning, woe


def bins_of(spark, values, *args, **options):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    return [r["b"] for r in df.select("i", bin_number(F.col("x"), *args, **options).alias("b")).orderBy("i").collect()]


def test_bin_number_sides(spark):
    values = [-INF, 0.0, 0.5, 1.0, 2.0, 3.0, INF, None, float("nan")]
    assert bins_of(spark, values, [-INF, 1.0, 2.0, INF], "right", 4) == [1, 1, 1, 1, 2, 3, 3, 4, 4]
    assert bins_of(spark, values, [0.0, 1.0, 2.0, 3.0], "right") == [None, None, 1, 1, 2, 3, None, None, None]
    assert bins_of(spark, values, [0.0, 1.0, 2.0, 3.0], "right_lowest") == [None, 1, 1, 1, 2, 3, None, None, None]
    assert bins_of(spark, values, [0.0, 1.0, 2.0, 3.0], "left") == [None, 1, 1, 2, 3, None, None, None, None]
    assert bins_of(spark, values, [0.0, 1.0, 2.0, 3.0], "left_highest") == [None, 1, 1, 2, 3, 3, None, None, None]


def test_bin_number_matches_digitize(spark):
    generator = np.random.default_rng(1)
    values = generator.integers(0, 40, 300).astype(float)
    cuts = [-INF] + [float(c) for c in range(1, 38, 2)] + [INF]
    assert bins_of(spark, [float(v) for v in values], cuts, "right") == list(np.digitize(values, cuts, right=True))


def test_equal_width_ends_exactly():
    edges = equal_width(0.1, 0.7, 3)
    assert edges[0] == 0.1 and edges[-1] == 0.7 and len(edges) == 4
    assert with_infinite_ends([3, 1, 3, INF]) == [-INF, 1.0, 3.0, INF]


def best_first(values, labels, leaves, share):
    """Plain best-first Gini tree on rows: the cuts in order."""
    order = np.argsort(values, kind="stable")
    x, y = np.asarray(values)[order], np.asarray(labels)[order]
    floor = max(math.ceil(share * len(x)), 1)

    def purity(part):
        n, b = len(part), part.sum()
        return ((n - b) ** 2 + b ** 2) / n

    def best(lo, hi):
        found = None
        for i in range(lo + 1, hi):
            if x[i] == x[i - 1] or i - lo < floor or hi - i < floor or 0 == y[lo:hi].sum() or y[lo:hi].sum() == hi - lo:
                continue
            gain = purity(y[lo:i]) + purity(y[i:hi]) - purity(y[lo:hi])
            if found is None or gain > found[0] + 1e-9:
                found = (gain, i)
        return found

    parts, cuts = {(0, len(x)): best(0, len(x))}, []
    while len(cuts) + 1 < leaves and any(parts.values()):
        lo, hi = max((p for p in parts if parts[p]), key=lambda p: (parts[p][0], -p[0]))
        at = parts.pop((lo, hi))[1]
        cuts.append((x[at - 1] + x[at]) / 2)
        parts[(lo, at)], parts[(at, hi)] = best(lo, at), best(at, hi)
    return sorted(cuts)


@pytest.mark.parametrize("tree_group", [200_000, 10])
def test_tree_edges_match_plain_tree(spark, tree_group):
    generator = np.random.default_rng(11)
    x = generator.integers(0, 120, 900).astype(float)
    y = (generator.random(900) < 0.1 + 0.5 * (x > 40) * (x < 80) + 0.2 * (x > 100)).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)] + [(None, 1)] * 5, "x double, label int")
    found = binning.tree_edges(df, ["x"], "label", 6, 0.05, tree_group)["x"]
    assert found[1:-1] == pytest.approx(best_first(x, y, 6, 0.05))


def test_tree_of_one_class_or_nothing_has_no_cut(spark):
    df = spark.createDataFrame([(float(i), None, 0) for i in range(20)], "x double, empty double, label int")
    assert binning.tree_edges(df, ["x", "empty"], "label") == {"x": [-INF, INF], "empty": [-INF, INF]}
    assert woe.woe_table(df, {"x": [-INF, INF]}).count() == 0


def test_chi_merge_joins_the_most_alike(spark):
    # Values 1 and 2 have the same bad rate, so have 3 and 4.
    rows = [(v, int(i < bads)) for v, bads in ((1.0, 2), (2.0, 2), (3.0, 7), (4.0, 7)) for i in range(10)]
    df = spark.createDataFrame(rows, "x double, label int")
    assert binning.chi_merge_edges(df, ["x"], "label", 2)["x"] == [-INF, 2.0, INF]


def plain_chi_merge(rows, bins):
    """Right edges left after joining the first most alike pair of neighbours again and again."""
    counts = {}
    for value, label in rows:
        if value is not None and label is not None:
            counts.setdefault(value, [0, 0])[label] += 1
    intervals = [[v, *counts[v]] for v in sorted(counts)]
    while len(intervals) > bins:
        costs = []
        for (_, a, b), (_, c, d) in zip(intervals, intervals[1:]):
            n = a + b + c + d
            cells = ((a, (a + b) * (a + c)), (b, (a + b) * (b + d)), (c, (c + d) * (a + c)), (d, (c + d) * (b + d)))
            costs.append(sum(Fraction((x * n - e) ** 2, e * n) for x, e in cells if e))
        at = costs.index(min(costs))
        edge, c, d = intervals.pop(at + 1)
        intervals[at] = [edge, intervals[at][1] + c, intervals[at][2] + d]
    return [i[0] for i in intervals[:-1]]


@pytest.mark.parametrize("values,bins", [(40, 5), (400, 6), (7, 2), (3, 10)])
def test_chi_merge_equals_plain_merging(spark, values, bins):
    rng = random.Random(values)
    rows = []
    for _ in range(1200):
        v = rng.choice([None, *range(values)])
        rows.append((v if v is None else v / 4 - 1, rng.choice([None, 0, 1]) if rng.random() < 0.1 else int(rng.random() < 0.1 + 0.6 * ((v or 0) > values / 2))))
    df = spark.createDataFrame([(*r, None) for r in rows], "x double, label int, empty double")
    assert binning.chi_merge_edges(df, ["x", "empty"], "label", bins) == {"x": [-INF, *plain_chi_merge(rows, bins), INF], "empty": [-INF, INF]}


@pytest.mark.parametrize("rows", [3, 5_000])
def test_chi_merge_with_a_small_heap(rows):
    rng = np.random.default_rng(rows)
    pdf = pd.DataFrame({"feature": "x", "value": rng.permutation(600) / 4, "good": rng.integers(1, rows, 600), "bad": rng.integers(0, rows, 600)})
    whole = in_task.chi_merge(pdf, 5)["cut"].tolist()
    assert len(whole) == 4
    assert [in_task.chi_merge(pdf, 5, pairs)["cut"].tolist() for pairs in (1, 7, 100)] == [whole] * 3


def test_chi_merge_holds_few_bytes_per_interval():
    n = 60_000
    pdf = pd.DataFrame({"feature": "x", "value": np.arange(n) / 4, "good": np.arange(n) % 2 * 2, "bad": (np.arange(n) + 1) % 2})
    tracemalloc.start()
    try:
        in_task.chi_merge(pdf, n - 10, 1_000)
        assert tracemalloc.get_traced_memory()[1] < 200 * n
    finally:
        tracemalloc.stop()


def test_woe_table_by_hand(spark):
    # bin 1: 3 good 1 bad, bin 2: 1 good 3 bad, bin 3 empty, missing: 2 good.
    rows = [(1.0, 0)] * 3 + [(1.0, 1)] + [(2.0, 0)] + [(2.0, 1)] * 3 + [(None, 0)] * 2
    df = spark.createDataFrame(rows, "x double, label int")
    table = {r["bin"]: r for r in woe.woe_table(df, {"x": [-INF, 1.5, 5.0, INF]}).collect()}
    assert sorted(table) == [1, 2, 4]
    assert table[1]["good_pct"] == 0.5 and table[1]["bad_pct"] == 0.25 and table[4]["bad_pct"] == 1e-4
    assert table[1]["woe"] == pytest.approx(math.log(2))
    assert table[2]["lift"] == pytest.approx(0.75 / 0.4) and table[4]["bin_range"] == "(null)"
    assert table[4]["cum_bad_rate"] == pytest.approx(0.4) and table[1]["ks"] == pytest.approx(1 / 3)
    assert table[1]["total_iv"] == pytest.approx(sum(r["iv"] for r in table.values()))
    assert sum(r["total"] for r in table.values()) == len(rows)


def test_simple_iv_of_text_and_single_class(spark):
    df = spark.createDataFrame([(float(i), "a", 0) for i in range(30)], "x double, s string, label int")
    assert {r["feature"]: r["iv"] for r in woe.simple_iv(df, ["x", "s"]).collect()} == {"x": 0.0, "s": 0.0}


def test_bins_of_groups_with_own_edges_in_code_of_one_size(spark):
    """Many groups make the plan no longer; missing values, values outside and groups without edges are left out."""
    generator = np.random.default_rng(8)
    rows = [(g, (None, float("nan"), float(v))[min(i, 2)], float(v * 3), int(generator.integers(0, 2)))
            for g in (None, *"abcdefgh") for i, v in enumerate(generator.normal(0, 1, 60).round(1))]
    df = spark.createDataFrame(rows, "g string, x double, y double, label int")
    edges = {(g,): {"x": [-1.0, -0.5, 0.0, 0.7 + n / 10, 1.5], "y": [-2.0, 2.0] if n else [1.0]} for n, g in enumerate((None, *"abcdefg"))}
    counted = {(r["feature"], r["g"], r["bin"]): (r["good"], r["bad"], r["labelled"], r["total"])
               for r in binning.grouped_bin_counts(df, edges, "label", "g").collect()}
    expected = {}
    for g, x, y, label in rows:
        for name, v in (("x", x), ("y", y)):
            e = edges.get((g,), {}).get(name, [])
            if len(e) > 1 and v is not None and e[0] <= v <= e[-1]:
                place = (name, g, max(1, sum(c < v for c in e)))
                good, bad, _, total = expected.get(place, (0, 0, 0, 0))
                expected[place] = (good + (label == 0), bad + label, total + 1, total + 1)
    assert counted == expected

    def size(groups):
        few = {g: edges[g] for g in list(edges)[:groups]}
        found = woe.simple_iv(df, ["x", "y"], "label", "g", edges=few)
        return len(found._jdf.queryExecution().optimizedPlan().toString())
    assert size(8) < 1.2 * size(2)


def test_compare_report_leaves_out_or_fills_absent_bins(spark):
    rows = [(1.0, i % 2, "train") for i in range(10)] + [(3.0, i % 2, "train") for i in range(10)]
    rows += [(1.0, i % 2, "oot") for i in range(10)]
    df = spark.createDataFrame(rows, "x double, label int, target string")
    edges = {"x": [-INF, 2.0, INF]}
    inner = woe.compare_report(df, edges, ("train", "oot")).first()["train_oot_psi"]
    dense = woe.compare_report(df, edges, ("train", "oot"), dense=True).first()["train_oot_psi"]
    assert inner == pytest.approx((0.5 - 1) * math.log(0.5))
    assert dense == pytest.approx(inner + (0.5 - 1e-4) * math.log(0.5 / 1e-4))


def test_learned_edges_use_train_only(app):
    edges = woe.learn_edges(app, ["amount"], max_leaf_nodes=4, min_samples_leaf=0.1)
    again = binning.tree_edges(app.where("target = 'train'"), ["amount"], "label", 4, 0.1)
    assert edges == again
