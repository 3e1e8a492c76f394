"""Extremely randomised trees for a 0/1 label, all trees grown at once level by level.

Every open node of every tree draws some features and, between the node's least and greatest value of each, a threshold; the draws follow
from hashes of seed, tree, node and feature. Of these splits the purest is made. A level takes two passes over the rows for all trees
together: ranges of the features per node, then rows and bads left of each drawn threshold. Tasks send sums per node, never rows, and the
sums are whole numbers: the same trees come out however the rows are partitioned.
"""

import random
import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pickled by value: executors need numpy and pyarrow, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Shares of rows drawn at most 0, 1, 2, ... times when as many are drawn, with replacement, as there are.
TIMES = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


@dataclass
class RandomTree:
    """Splits by heap place (children of i are 2 i + 1 for values up to the threshold and 2 i + 2) and (rows, bads) of all nodes."""

    splits: dict = field(default_factory=dict)
    sizes: dict = field(default_factory=dict)

    def leaves(self):
        """(path, rows, bads) of every leaf in order; a path lists (feature, is_left, threshold)."""
        def walk(i, path):
            if i not in self.splits:
                yield path, *self.sizes.get(i, (0, 0))
                return
            f, at = self.splits[i]
            yield from walk(2 * i + 1, [*path, (f, True, at)])
            yield from walk(2 * i + 2, [*path, (f, False, at)])
        return list(walk(0, []))


def number(*parts):
    """Uniform number in [0, 1) that follows from ``parts``."""
    return random.Random("-".join(map(str, parts))).random()


def times_drawn(pick, seed, tree):
    """How often each row is in the sample of a tree."""
    z = pick.view(np.uint64) ^ np.uint64(random.Random(f"{seed}-{tree}-rows").getrandbits(64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    u = (z ^ (z >> np.uint64(31))) / 2.0 ** 64
    return np.searchsorted(TIMES, u, "right")


class Batch:
    """Rows of an Arrow batch: columns of values, label, and per tree how often they count and the node they are in."""

    def __init__(self, batch, width):
        self.x = [batch.column(f"x{i}").to_numpy() for i in range(width)]
        self.y = batch.column("y").to_numpy()
        self.pick = batch.column("pick").to_numpy()

    def of_tree(self, splits, t, seed, bootstrap):
        """Rows in the sample of tree ``t``, how often they count, and their nodes."""
        times = times_drawn(self.pick, seed, t) if bootstrap else np.ones(len(self.y), np.int64)
        rows = np.flatnonzero(times)
        node = np.zeros(len(rows), np.int64)
        for i in sorted(splits):
            f, at = splits[i]
            inside = node == i
            node[inside] = 2 * i + 2 - (self.x[f][rows[inside]] <= at)
        return rows, times[rows], node


def ranges(state, width, trees, open_nodes, seed, bootstrap):
    """{(tree, node): (least values, greatest values)} of the open nodes, from one pass."""
    splits = {t: trees[t].splits for t in open_nodes}

    def measure(batches):
        found = {}
        for batch in batches:
            held = Batch(batch, width)
            for t, nodes in open_nodes.items():
                rows, _, node = held.of_tree(splits[t], t, seed, bootstrap)
                for i in nodes:
                    own = rows[node == i] if splits[t] else rows
                    if not len(own):
                        continue
                    values = [x[own] for x in held.x]
                    low, high = np.array([v.min() for v in values]), np.array([v.max() for v in values])
                    a, b = found.get((t, i), (low, high))
                    found[t, i] = np.minimum(a, low), np.maximum(b, high)
        keys = list(found)
        yield pa.RecordBatch.from_pydict({
            "tree": pa.array([t for t, _ in keys], pa.int32()), "node": pa.array([i for _, i in keys], pa.int32()),
            "low": pa.array([found[k][0].tolist() for k in keys], pa.list_(pa.float64())), "high": pa.array([found[k][1].tolist() for k in keys], pa.list_(pa.float64()))})

    parts = state.mapInArrow(measure, "tree int, node int, low array<double>, high array<double>")
    ends = parts.select("tree", "node", F.posexplode(F.arrays_zip("low", "high"))).groupBy("tree", "node", "pos").agg(
        F.min("col.low").alias("low"), F.max("col.high").alias("high"))
    per_node = ends.groupBy("tree", "node").agg(F.array_sort(F.collect_list(F.struct("pos", "low", "high"))).alias("e"))
    return {(r["tree"], r["node"]): ([e["low"] for e in r["e"]], [e["high"] for e in r["e"]]) for r in per_node.collect()}


def drawn_splits(low, high, count, seed, t, i):
    """Up to ``count`` (feature, threshold) of a node: features in drawn order, those with one value only are passed over."""
    order = sorted(range(len(low)), key=lambda f: number(seed, t, i, f, "order"))
    varied = [f for f in order if low[f] < high[f]][:count]
    found = []
    for f in varied:
        at = low[f] + number(seed, t, i, f, "at") * (high[f] - low[f])
        found.append((f, at if at < high[f] else low[f]))
    return found


def split_counts(state, width, trees, drawn, seed, bootstrap):
    """{(tree, node, position of the drawn split): (rows, bads) left of it}; position -1 has all of the node."""
    per_tree = {}
    for (t, i), options in drawn.items():
        per_tree.setdefault(t, {})[i] = options
    splits = {t: trees[t].splits for t in per_tree}

    def count(batches):
        sums = {}
        for batch in batches:
            held = Batch(batch, width)
            for t, nodes in per_tree.items():
                rows, times, node = held.of_tree(splits[t], t, seed, bootstrap)
                for i, options in nodes.items():
                    inside = node == i
                    own, n = (rows[inside], times[inside]) if splits[t] else (rows, times)
                    bad = n * held.y[own]
                    for p, (f, at) in [(-1, (None, None)), *enumerate(options)]:
                        left = held.x[f][own] <= at if f is not None else slice(None)
                        total = sums.setdefault((t, i, p), [0, 0])
                        total[0] += int(n[left].sum())
                        total[1] += int(bad[left].sum())
        keys = list(sums)
        yield pa.RecordBatch.from_pydict({
            **{name: pa.array([k[j] for k in keys], pa.int32()) for j, name in enumerate(("tree", "node", "place"))},
            **{name: pa.array([sums[k][j] for k in keys], pa.int64()) for j, name in enumerate(("n", "bad"))}})

    parts = state.mapInArrow(count, "tree int, node int, place int, n bigint, bad bigint")
    summed = parts.groupBy("tree", "node", "place").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).collect()
    return {(r["tree"], r["node"], r["place"]): (r["n"], r["bad"]) for r in summed}


def purity(n, bad):
    """Grows as both sides of a split get purer (for one node's splits)."""
    return (bad * bad + (n - bad) * (n - bad)) / n


def fit(rows: DataFrame, features, label="label", key=None, n_trees=100, max_depth=3, min_leaf=100, max_features=0.5, bootstrap=True, seed=2024,
        fill_value=-999.0):
    """List of :class:`RandomTree` over the rows whose label is 0 or 1; missing values are ``fill_value``.

    A leaf keeps at least ``min_leaf`` rows, counted as often as they are drawn. With ``bootstrap`` each tree draws as many rows as there are,
    with replacement, by a hash of ``key`` (without it, of the row's values). Of equally pure splits the first one drawn is made. Features
    of one value are never split; without rows or features trees are a single leaf.
    """
    features = list(features)
    if not features:
        return [RandomTree() for _ in range(n_trees)]
    values = [F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(fill_value)), F.lit(fill_value)) for c in features]
    pick = F.xxhash64(F.col(key)) if key else F.xxhash64(*values, F.col(label))
    state = rows.select(*[v.alias(f"x{i}") for i, v in enumerate(values)], F.col(label).cast("bigint").alias("y"), pick.alias("pick")).where(
        F.col("y").isin(0, 1)).persist(StorageLevel.MEMORY_AND_DISK)
    trees = [RandomTree() for _ in range(n_trees)]
    open_nodes = {t: {0} for t in range(n_trees)}
    count = max(1, int(max_features * len(features))) if max_features <= 1 else min(int(max_features), len(features))
    try:
        for _ in range(max_depth):
            if not any(open_nodes.values()):
                break
            ends = ranges(state, len(features), trees, open_nodes, seed, bootstrap)
            drawn = {k: drawn_splits(*v, count, seed, *k) for k, v in ends.items()}
            sums = split_counts(state, len(features), trees, drawn, seed, bootstrap)
            open_nodes = {}
            for (t, i), options in drawn.items():
                n, bad = trees[t].sizes[i] = sums[t, i, -1]
                best = None
                for p, option in enumerate(options):
                    ln, lbad = sums[t, i, p]
                    if min(ln, n - ln) >= max(min_leaf, 1) and 0 < bad < n:
                        value = purity(ln, lbad) + purity(n - ln, bad - lbad)
                        if best is None or value > best[0]:
                            best = value, option, (ln, lbad)
                if best:
                    _, trees[t].splits[i], left = best
                    trees[t].sizes[2 * i + 1], trees[t].sizes[2 * i + 2] = left, (n - left[0], bad - left[1])
                    open_nodes.setdefault(t, set()).update((2 * i + 1, 2 * i + 2))
    finally:
        state.unpersist()
    return trees
