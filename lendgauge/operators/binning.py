"""Bin edges of features, and label counts per bin.

Edges are short lists of numbers kept on the driver: ``{feature: [edges]}`` with both outer edges.
"""

import heapq
import math
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bins import INF, bin_number, equal_width, interval_text, with_infinite_ends
from ..functions.in_task import alike_runs, chi_merge, grow_tree
from .ranks import SMALL_GROUP, quantiles, running_totals, unpivot_numeric

# Features per counting pass; wider tables take several column-pruned scans.
CHUNK = 64
# Distinct values of one feature that one task may grow a tree on.
TREE_GROUP = 200_000


# ---------------------------------------------------------------- edges

def equal_frequency_edges(df: DataFrame, columns, bins=10, by=(), small_group=SMALL_GROUP):
    """Distinct quantile edges from minimum to maximum: ``{group: {column: edges}}`` (``()`` ungrouped)."""
    shares = [i / bins for i in range(bins + 1)]
    found = quantiles(df, columns, shares, by, small_group)
    return {group: {c: sorted(set(v)) if v else [] for c, v in per.items()} for group, per in found.items()}


def equal_frequency_cuts(df: DataFrame, columns, bins=10, small_group=SMALL_GROUP):
    """Equal-frequency edges whose ends are opened to minus and plus infinity."""
    shares = [i / bins for i in range(1, bins)]
    found = quantiles(df, columns, shares, (), small_group)[()]
    return {c: with_infinite_ends(v or []) for c, v in found.items()}


def equal_width_edges(df: DataFrame, columns, bins=10):
    """Evenly spaced edges between minimum and maximum; [] for a column without values."""
    columns = list(columns)
    ends = df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{n}{i}")
                    for i, c in enumerate(columns) for f, n in ((F.min, "low"), (F.max, "high"))]).first()
    return {c: [] if ends[f"low{i}"] is None else equal_width(ends[f"low{i}"], ends[f"high{i}"], bins)
            for i, c in enumerate(columns)}


def value_histogram(df: DataFrame, columns, label) -> DataFrame:
    """(feature, value, good, bad): label counts per distinct value, rows without a value left out."""
    flags = df.select(
        F.when(F.col(label) == 0, 1).otherwise(0).alias("_good"),
        F.when(F.col(label) == 1, 1).otherwise(0).alias("_bad"),
        *[F.col(f"`{c}`") for c in columns])
    long = unpivot_numeric(flags, ["_good", "_bad"], columns).where(F.col("value").isNotNull())
    return long.groupBy("feature", "value").agg(F.sum("_good").alias("good"), F.sum("_bad").alias("bad"))


def tree_edges(df: DataFrame, columns, label, max_leaf_nodes=6, min_samples_leaf=0.05, tree_group=TREE_GROUP):
    """Edges of a best-first Gini tree per feature, ends opened to infinity.

    The leaf with the largest gain is split until ``max_leaf_nodes``; both children keep at least
    ``ceil(min_samples_leaf * n)`` rows; cuts lie midway between neighbouring values; of equal gains
    the lowest cut wins. Features with few distinct values are grown in one task each, all others by
    rounds of one aggregation over running totals. Both give the same edges.
    """
    columns = list(columns)
    histogram = value_histogram(df, columns, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = {r["feature"]: r["n"] for r in
                 histogram.groupBy("feature").agg(F.count("*").alias("n")).collect()}
        small = [c for c in columns if 0 < sizes.get(c, 0) <= tree_group]
        large = [c for c in columns if sizes.get(c, 0) > tree_group]
        cuts = {c: [] for c in columns}
        if small:
            grown = histogram.where(F.col("feature").isin(small)).groupBy("feature").applyInPandas(
                lambda pdf: grow_tree(pdf, max_leaf_nodes, min_samples_leaf), "feature string, cut double")
            for r in grown.collect():
                cuts[r["feature"]].append(r["cut"])
        if large:
            cuts.update(_grow_by_rounds(histogram.where(F.col("feature").isin(large)), max_leaf_nodes,
                                        min_samples_leaf, tree_group))
    finally:
        histogram.unpersist()
    return {c: with_infinite_ends(v) for c, v in cuts.items()}


def _grow_by_rounds(histogram, max_leaf_nodes, min_samples_leaf, group):
    spark = histogram.sparkSession
    totals = running_totals(histogram, ["feature"], "value", ["good", "bad"], group)
    totals = totals.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        whole = totals.groupBy("feature").agg(
            F.max("value").alias("high"), F.sum("good").alias("g"), F.sum("bad").alias("b")).collect()
        # A leaf is (low, high, good before it, bad before it, good in it, bad in it), low excluded.
        open_leaves = {r["feature"]: [(-INF, r["high"], 0, 0, r["g"], r["b"])] for r in whole}
        floors = {r["feature"]: max(math.ceil(min_samples_leaf * (r["g"] + r["b"])), 1) for r in whole}
        queues, splits = {f: [] for f in open_leaves}, {f: [] for f in open_leaves}
        while any(open_leaves.values()):
            for feature, leaf, gain, at, left_g, left_b in _score_leaves(spark, totals, open_leaves, floors):
                heapq.heappush(queues[feature], (-gain, leaf, at, left_g, left_b))
            open_leaves = {f: [] for f in open_leaves}
            for feature, queue in queues.items():
                if queue and len(splits[feature]) + 1 < max_leaf_nodes:
                    _, (low, high, g0, b0, g, b), at, left_g, left_b = heapq.heappop(queue)
                    splits[feature].append(at)
                    if len(splits[feature]) + 1 < max_leaf_nodes:
                        open_leaves[feature] = [(low, at, g0, b0, left_g, left_b),
                                                (at, high, g0 + left_g, b0 + left_b, g - left_g, b - left_b)]
        return _midpoints(spark, totals, splits)
    finally:
        totals.unpersist()


def _score_leaves(spark, totals, open_leaves, floors):
    rows, kept = [], []
    for feature, leaves in open_leaves.items():
        for leaf in leaves:
            if leaf[4] and leaf[5]:
                rows.append((feature, len(kept), *map(float, leaf[:2]), *map(int, leaf[2:]), floors[feature]))
                kept.append((feature, leaf))
    if not rows:
        return []
    table = spark.createDataFrame(
        rows, "feature string, leaf int, low double, high double, g0 long, b0 long, g long, b long, floor long")
    at = totals.join(F.broadcast(table), "feature").where(
        (F.col("value") > F.col("low")) & (F.col("value") < F.col("high")))
    lg, lb = (F.col("cum_good") - F.col("g0")).cast("double"), (F.col("cum_bad") - F.col("b0")).cast("double")
    at = at.select("leaf", "value", "floor", "g", "b", lg.alias("lg"), lb.alias("lb"))
    left_n, right_n = F.col("lg") + F.col("lb"), F.col("g") + F.col("b") - F.col("lg") - F.col("lb")
    rg, rb = F.col("g") - F.col("lg"), F.col("b") - F.col("lb")
    gain = ((F.col("lg") * F.col("lg") + F.col("lb") * F.col("lb")) / left_n + (rg * rg + rb * rb) / right_n)
    scored = at.where((left_n >= F.col("floor")) & (right_n >= F.col("floor"))).groupBy("leaf").agg(
        F.max(F.struct(gain.alias("gain"), (-F.col("value")).alias("minus"), "lg", "lb")).alias("best"))
    result = []
    for r in scored.collect():
        feature, leaf = kept[r["leaf"]]
        g, b = float(leaf[4]), float(leaf[5])
        result.append((feature, leaf, r["best"]["gain"] - (g * g + b * b) / (g + b), -r["best"]["minus"],
                       int(r["best"]["lg"]), int(r["best"]["lb"])))
    return result


def _midpoints(spark, totals, splits):
    rows = [(f, float(at)) for f, cuts in splits.items() for at in cuts]
    if not rows:
        return {f: [] for f in splits}
    table = spark.createDataFrame(rows, "feature string, at double")
    following = totals.join(F.broadcast(table), "feature").where(F.col("value") > F.col("at")).groupBy(
        "feature", "at").agg(F.min("value").alias("following")).collect()
    result = {f: [] for f in splits}
    for r in following:
        result[r["feature"]].append((r["at"] + r["following"]) / 2)
    return result


def chi_merge_edges(df: DataFrame, columns, label, bins=10):
    """ChiMerge edges from all distinct values: the neighbours most alike are joined until ``bins`` intervals are left, the first of equals.

    Values are sorted by range, and neighbours of one bad rate (their chi-square is 0, so they are joined before all others, in any order) are
    joined within the ranges. What is left of a feature, three numbers per change of the bad rate, is merged in one task. Rows without a
    value or a label have no part.
    """
    columns = list(columns)
    known = value_histogram(df, columns, label).where("good + bad > 0")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = known.repartitionByRange(parts, "feature", "value").sortWithinPartitions("feature", "value")
    runs = ranged.mapInArrow(alike_runs, "feature string, value double, good bigint, bad bigint")
    found = runs.groupBy("feature").applyInPandas(lambda pdf: chi_merge(pdf, bins), "feature string, cut double").collect()
    cuts = {c: [] for c in columns}
    for r in found:
        cuts[r["feature"]].append(r["cut"])
    return {c: with_infinite_ends(sorted(v)) for c, v in cuts.items()}


# ---------------------------------------------------------------- counts

def grouped_bin_counts(df: DataFrame, edges_by_group, label, by) -> DataFrame:
    """(feature, by, bin, good, bad, labelled, total) where every group has edges of its own: ``{(group,): {feature: edges}}``.

    Bins are closed on the right, the first on both sides. Missing values, values outside the edges and groups with fewer than two edges
    are left out. Rows are made long before they are binned and find their edges in a broadcast table, so that the generated code
    doesn't grow with groups and features (beyond a size it isn't compiled); counts are combined before the shuffle.
    """
    rows = [(feature, *group, float(e[0]), float(e[-1]), [float(x) for x in e[1:-1]])
            for group, per in edges_by_group.items() for feature, e in per.items() if len(e) >= 2]
    schema = T.StructType([T.StructField("_f", T.StringType()), T.StructField("_g", df.schema[by].dataType), T.StructField("_low", T.DoubleType()),
                           T.StructField("_high", T.DoubleType()), T.StructField("_inner", T.ArrayType(T.DoubleType()))])
    table = df.sparkSession.createDataFrame(rows, schema)
    long = unpivot_numeric(df.withColumns({"_by": F.col(by), "_y": F.col(label)}), ["_by", "_y"], sorted({r[0] for r in rows}))
    present = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    known = present.join(F.broadcast(table), (F.col("feature") == F.col("_f")) & F.col("_by").eqNullSafe(F.col("_g")))
    binned = known.where((F.col("value") >= F.col("_low")) & (F.col("value") <= F.col("_high"))).withColumn("_at", F.lit(0))
    step = 1 << max(len(r[-1]) for r in rows).bit_length()
    while step := step // 2:
        # Binary search for the number of inner edges left of the value.
        moves = F.get("_inner", F.col("_at") + (step - 1)) < F.col("value")
        binned = binned.withColumn("_at", F.col("_at") + F.when(moves, step).otherwise(0))
    return binned.groupBy("feature", F.col("_by").alias(by), (F.col("_at") + 1).alias("bin")).agg(
        F.count_if(F.col("_y") == 0).alias("good"), F.count_if(F.col("_y") == 1).alias("bad"),
        F.count("_y").alias("labelled"), F.count("*").alias("total"))


def bin_counts(df: DataFrame, edges, label, by=(), closed="right", missing="own", number=None) -> DataFrame:
    """(feature, *by, bin, good, bad, labelled, total) for every feature in ``edges``.

    Bins are computed on the wide row and only the small bin numbers are unpivoted, so the shuffle
    carries one row per feature, group and bin. ``missing='own'`` numbers missing values after the
    last bin; None leaves them and values outside the edges out. ``number(feature)`` may give another
    bin Column.
    """
    by = list(by)
    number = number or (lambda c: bin_number(F.col(f"`{c}`"), edges[c], closed, len(edges[c]) if missing else None))
    names = [c for c, e in edges.items() if len(e) >= 2]
    if not names:
        schema = T.StructType([T.StructField("feature", T.StringType())] + [df.schema[k] for k in by])
        for n in ("bin int", "good bigint", "bad bigint", "labelled bigint", "total bigint"):
            schema = schema.add(n.split()[0], T.IntegerType() if n.endswith(" int") else T.LongType())
        return df.sparkSession.createDataFrame([], schema)
    groups = [F.col(k).alias(f"_g{i}") for i, k in enumerate(by)]
    flags = [F.lit(None).cast("int").alias("_y")] if label is None else [F.col(label).alias("_y")]
    parts = []
    for start in range(0, len(names), CHUNK):
        chunk = names[start:start + CHUNK]
        wide = df.select(*groups, *flags, *[number(c).alias(c) for c in chunk])
        long = wide.unpivot([f"_g{i}" for i in range(len(by))] + ["_y"], chunk, "feature", "bin")
        parts.append(long.where(F.col("bin").isNotNull()).groupBy(
            "feature", *[f"_g{i}" for i in range(len(by))], "bin").agg(
                F.count_if(F.col("_y") == 0).alias("good"), F.count_if(F.col("_y") == 1).alias("bad"),
                F.count("_y").alias("labelled"), F.count("*").alias("total")))
    counted = reduce(DataFrame.unionByName, parts)
    return counted.withColumnsRenamed({f"_g{i}": k for i, k in enumerate(by)})


def edge_frame(spark, edges, closed="right", with_missing=True) -> DataFrame:
    """(feature, bin, low, high, bin_range) for display and for dense joins."""
    rows = []
    for feature, e in edges.items():
        for n in range(1, len(e)):
            first = n == 1 and closed == "right_lowest"
            rows.append((feature, n, float(e[n - 1]), float(e[n]), interval_text(e[n - 1], e[n], closed, first)))
        if with_missing and len(e) > 1:
            rows.append((feature, len(e), None, None, interval_text(None, None)))
    return spark.createDataFrame(rows, "feature string, bin int, low double, high double, bin_range string")


def assign_bins(df: DataFrame, edges, closed="right", suffix="_bin") -> DataFrame:
    """Row-level bin numbers beside the features."""
    return df.withColumns({f"{c}{suffix}": bin_number(F.col(f"`{c}`"), e, closed, len(e)) for c, e in edges.items()})


def binning_explorer(df: DataFrame, variable, label="label", method="decision_tree", n_bins=10,
                     min_samples_leaf=0.02, max_leaf_nodes=10) -> DataFrame:
    """Bin table of one variable with edges by ``decision_tree``, ``quantile`` or ``chi``."""
    from .woe import woe_table

    pair = df.select(variable, label).dropna()
    if method == "decision_tree":
        edges = tree_edges(pair, [variable], label, max_leaf_nodes, min_samples_leaf)
    elif method == "quantile":
        edges = equal_frequency_cuts(pair, [variable], n_bins)
    elif method == "chi":
        edges = chi_merge_edges(pair, [variable], label, n_bins)
    else:
        raise ValueError(f"unknown method {method!r}")
    return woe_table(pair, edges, label)
