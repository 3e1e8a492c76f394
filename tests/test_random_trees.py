"""Extremely randomised trees: draws and leaves against plain counts over all rows, on any partitioning."""

import random

import numpy as np
import pytest

from lendgauge.operators import mining, random_trees


def table(spark, n=400):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        a, b = rng.choice([None, 1.0, 2.0, float("nan"), 7.5]), round(rng.gauss(0, 3), 2)
        rows.append((i, a, b, 4.0, b, (int(rng.random() < 0.2 + 0.5 * (b > 1))) if i % 40 else None))
    return rows, spark.createDataFrame(rows, "app_id long, a double, b double, constant double, y double, label int")


def plain_trees(rows, times, count, max_depth, min_leaf, seed):
    """Splits and leaves of each tree, by walking over lists of rows."""
    data = [[-999.0 if x is None or x != x else x for x in r[1:5]] for r in rows]
    out = []
    for t, own in enumerate(times):
        splits, sizes, members = {}, {}, {0: [i for i in range(len(rows)) if own[i]]}
        for node in range(2 ** max_depth - 1):
            if node not in members:
                continue
            inside = members[node]
            n, bad = sum(own[i] for i in inside), sum(own[i] * rows[i][5] for i in inside)
            sizes[node] = n, bad
            low, high = ([f(data[i][k] for i in inside) for k in range(4)] for f in (min, max))
            best = None
            for f, at in random_trees.drawn_splits(low, high, count, seed, t, node):
                assert low[f] <= at < high[f]
                left = [i for i in inside if data[i][f] <= at]
                ln, lbad = sum(own[i] for i in left), sum(own[i] * rows[i][5] for i in left)
                if min(ln, n - ln) < min_leaf or not 0 < bad < n:
                    continue
                # Weighted Gini impurity of both sides.
                impurity = sum(m * 2 * (c / m) * (1 - c / m) for m, c in ((ln, lbad), (n - ln, bad - lbad)))
                if best is None or impurity < best[0] - 1e-9:
                    best = impurity, (f, at), left
            if best:
                splits[node] = best[1]
                members[2 * node + 1], members[2 * node + 2] = best[2], [i for i in inside if i not in set(best[2])]
        for node, inside in members.items():
            sizes[node] = sum(own[i] for i in inside), sum(own[i] * rows[i][5] for i in inside)
        out.append((splits, sizes))
    return out


@pytest.mark.parametrize("bootstrap", [True, False])
def test_all_leaves_equal_plain_counts(spark, bootstrap):
    rows, df = table(spark)
    settings = dict(key="app_id", n_trees=100, max_depth=3, min_leaf=20, max_features=0.5, bootstrap=bootstrap, seed=9)
    trees = random_trees.fit(df.repartition(3), ["a", "b", "constant", "y"], **settings)
    known = [r for r in rows if r[5] is not None]
    picks = {r.app_id: r.p for r in df.selectExpr("app_id", "xxhash64(app_id) AS p").collect()}
    pick = np.array([picks[r[0]] for r in known])
    times = [random_trees.times_drawn(pick, 9, t).tolist() if bootstrap else [1] * len(known) for t in range(100)]
    for tree, (splits, sizes) in zip(trees, plain_trees(known, times, 2, 3, 20, 9)):
        assert tree.splits == splits and tree.sizes == sizes
        assert sum(n for _, n, _ in tree.leaves()) == sizes[0][0]
    assert len({str(t.splits) for t in trees}) > 90


def test_same_trees_however_rows_lie(spark):
    _, df = table(spark)
    one, other = (random_trees.fit(df.repartition(n), ["a", "b", "y"], n_trees=10, min_leaf=10) for n in (1, 6))
    assert one == other


def test_sample_sizes():
    times = random_trees.times_drawn(np.arange(100_000), 1, 2)
    assert times.mean() == pytest.approx(1, abs=0.02) and (times == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)


def test_rules_and_odd_tables(spark):
    rows, df = table(spark)
    rules = mining.extract_rules(mining.fit_trees(df, ["a", "b"], n_trees=5, min_leaf=20), ["a", "b"])
    assert rules and len(rules) == len(set(rules)) and all(" <= " in r or " > " in r for r in rules)
    for odd in (df.where("false"), df.where("label = 1")):
        assert mining.extract_rules(mining.fit_trees(odd, ["a", "b"], n_trees=3, min_leaf=1), ["a", "b"]) == []
    assert random_trees.fit(df, [], n_trees=2) == [random_trees.RandomTree()] * 2
    with pytest.raises(ValueError):
        mining.fit_trees(df, ["a"], kind="forest")


def test_unknown_lines_of_a_tree_are_refused():
    class Odd:
        toDebugString = "Tree\n  If (feature 0 in {1.0})\n   Predict: 0.1\n"

    with pytest.raises(ValueError):
        mining.extract_rules(Odd(), ["a"])
