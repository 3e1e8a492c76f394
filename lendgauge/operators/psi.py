"""Population stability index in its variants.

They differ in edges, in which side of a bin is closed and in smoothing, so each has its own
function. All count with one pass of conditional counts per (feature, bin); shares and logarithms
are taken on the bin-sized result, joined to the full bin list so that empty bins count.
"""

from bisect import bisect_right

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import INF, bin_number, equal_width
from ..functions.guards import PSI_EPSILON, clip, psi_term, smooth
from .binning import CHUNK, edge_frame, equal_frequency_cuts, equal_frequency_edges, equal_width_edges
from .ranks import SMALL_GROUP, quantiles

# A constant base in the detailed variant, and the stability bands.
CONSTANT_BASE = 999999.0
STABLE_BELOW, UNSTABLE_ABOVE = 0.1, 0.25


def _side_counts(df, edges, base, actual, closed):
    """(feature, bin, expected, actual) with every bin present."""
    names = [c for c, e in edges.items() if len(e) >= 2]
    parts = None
    for start in range(0, len(names), CHUNK):
        chunk = names[start:start + CHUNK]
        wide = df.select(base.alias("_e"), actual.alias("_a"),
                         *[bin_number(F.col(f"`{c}`"), edges[c], closed).alias(c) for c in chunk])
        long = wide.unpivot(["_e", "_a"], chunk, "feature", "bin").where(F.col("bin").isNotNull())
        counted = long.groupBy("feature", "bin").agg(
            F.count_if("_e").alias("expected"), F.count_if("_a").alias("actual"))
        parts = counted if parts is None else parts.unionByName(counted)
    bins = edge_frame(df.sparkSession, {c: edges[c] for c in names}, closed, with_missing=False)
    if parts is None:
        return bins.withColumns({"expected": F.lit(0), "actual": F.lit(0)})
    return bins.join(parts, ["feature", "bin"], "left").na.fill(0, ["expected", "actual"])


def _terms(counts, epsilon=PSI_EPSILON):
    """Add expected_share, actual_share and psi per bin; shares are of the counted rows."""
    group = Window.partitionBy("feature")
    shares = counts.withColumns({
        "expected_share": F.try_divide("expected", F.sum("expected").over(group)),
        "actual_share": F.try_divide("actual", F.sum("actual").over(group)),
    })
    return shares.withColumn("psi", psi_term(smooth("actual_share", epsilon), smooth("expected_share", epsilon)))


def _pair_edges(scope, columns, bins, method, small_group):
    if method == "equal_width":
        return equal_width_edges(scope, columns, bins)
    if method == "equal_frequency":
        return equal_frequency_edges(scope, columns, bins, (), small_group)[()]
    raise ValueError("method must be 'equal_width' or 'equal_frequency'")


def psi_detail(df: DataFrame, column, base, actual, bins=10, method="equal_width", small_group=SMALL_GROUP) -> DataFrame:
    """Bin table of one variable between two row conditions, with a summary row (bin 0).

    The first bin is closed on both sides, the others on the right. A constant base has PSI 999999.
    """
    if dict(df.dtypes)[column] == "string":
        raise TypeError(f"{column} is text; a number is needed")
    scope = df.where((base | actual) & F.col(column).isNotNull())
    ends = scope.agg(F.min(F.when(base, F.col(column))).alias("low"), F.max(F.when(base, F.col(column))).alias("high")).first()
    schema = ("bin int, score_range string, expected bigint, expected_pct double, actual bigint, actual_pct double, "
              "diff_pct double, ln_ratio double, psi double, is_max boolean")
    if ends["low"] == ends["high"]:
        return df.sparkSession.createDataFrame(
            [(0, "summary", None, None, None, None, None, None, CONSTANT_BASE, False)], schema)
    edges = _pair_edges(scope, [column], bins, method, small_group)
    counted = _terms(_side_counts(scope, edges, base, actual, "right_lowest"))
    whole = Window.partitionBy("feature")
    rows = counted.select(
        "bin", F.col("bin_range").alias("score_range"), "expected", (F.col("expected_share") * 100).alias("expected_pct"),
        "actual", F.round(F.col("actual_share") * 100, 2).alias("actual_pct"),
        F.round((F.col("actual_share") - F.col("expected_share")) * 100, 2).alias("diff_pct"),
        F.ln(smooth("actual_share", PSI_EPSILON) / smooth("expected_share", PSI_EPSILON)).alias("ln_ratio"),
        "psi", (F.col("psi") == F.max("psi").over(whole)).alias("is_max"))
    summary = rows.agg(F.sum("expected").alias("expected"), F.sum("actual").alias("actual"), F.sum("psi").alias("psi"))
    summary = summary.select(
        F.lit(0).alias("bin"), F.lit("summary").alias("score_range"), "expected", F.lit(100.0).alias("expected_pct"),
        "actual", F.lit(100.0).alias("actual_pct"), F.lit(None).cast("double").alias("diff_pct"),
        F.lit(None).cast("double").alias("ln_ratio"), "psi", F.lit(False).alias("is_max"))
    return rows.unionByName(summary)


def psi_between(df: DataFrame, columns, base, actual, bins=10, method="equal_width", small_group=SMALL_GROUP) -> DataFrame:
    """(feature, psi) of many variables between two row conditions in one pass.

    Edges span both sides; bins are closed on the left, the last one on both sides. A constant
    variable has PSI 0.
    """
    columns = list(columns)
    scope = df.where(base | actual)
    edges = _pair_edges(scope, columns, bins, method, small_group)
    usable = {c: e for c, e in edges.items() if len(e) > 1 and e[0] < e[-1]}
    summed = _terms(_side_counts(scope, usable, base, actual, "left_highest")).groupBy("feature").agg(
        F.sum("psi").alias("psi"))
    listed = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return listed.join(summed, "feature", "left").select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def psi_filter(df: DataFrame, columns, expected=("train",), actual=("oot",), threshold=0.05, target="target",
               method="equal_width", bins=10) -> DataFrame:
    """PSI per variable between split groups, highest first; ``kept`` where ``psi <= threshold``."""
    result = psi_between(df, columns, F.col(target).isin(*expected), F.col(target).isin(*actual), bins, method)
    return result.withColumn("kept", F.col("psi") <= threshold).orderBy(F.desc("psi"), "feature")


def month_psi(df: DataFrame, column, month_col="month_time", base_month=None, bins=10, method="equal_width",
              small_group=SMALL_GROUP) -> DataFrame:
    """(month, psi) of every month against one month (the earliest by default).

    The edges of each month span that month and the base month. Base rows are counted once on the
    merged grid of all edges, months on their own edges; the few counts are then put together.
    """
    present = df.where(F.col(month_col).isNotNull() & F.col(column).isNotNull()).select(
        F.col(month_col).alias("_m"), F.col(column).cast("double").alias("_x"))
    ends = {r["_m"]: (r["low"], r["high"]) for r in present.groupBy("_m").agg(
        F.min("_x").alias("low"), F.max("_x").alias("high")).collect()}
    base_month = base_month if base_month is not None else min(ends)
    base_low, base_high = ends[base_month]
    if method == "equal_width":
        edges = {m: equal_width(min(low, base_low), max(high, base_high), bins) for m, (low, high) in ends.items()}
    elif method == "equal_frequency":
        edges = _pair_quantiles(present, ends, base_month, bins, small_group)
    else:
        raise ValueError("method must be 'equal_width' or 'equal_frequency'")
    usable = {m: e for m, e in edges.items() if len(e) > 1 and e[0] < e[-1]}
    base_counts = _grid_counts(present.where(F.col("_m") == base_month), sorted({x for e in usable.values() for x in e}))
    own = _own_counts(present, usable, bins)
    rows = []
    for m in ends:
        e = usable.get(m)
        if e is None:
            rows.append((m, None, None, None))
            continue
        last = len(e) - 1
        expected = [0] * last
        for left, n in base_counts.items():
            expected[min(bisect_right(e, left), last) - 1] += n
        rows += [(m, n + 1, expected[n], own.get((m, n + 1), 0)) for n in range(last)]
    counts = df.sparkSession.createDataFrame(
        rows, f"feature {df.schema[month_col].dataType.simpleString()}, bin int, expected bigint, actual bigint")
    return _terms(counts).groupBy(F.col("feature").alias("month")).agg(
        F.coalesce(F.sum("psi"), F.lit(0.0)).alias("psi")).orderBy("month")


def _grid_counts(rows, grid):
    """{left edge: rows} on a fine grid, cells closed on the left."""
    if len(grid) < 2:
        return {}
    cells = Bucketizer(splits=[-INF] + grid + [INF], inputCol="_x", outputCol="_cell").transform(rows)
    counted = cells.groupBy("_cell").agg(F.count("*").alias("n")).collect()
    return {grid[int(r["_cell"]) - 1]: r["n"] for r in counted if r["_cell"] >= 1}


def _own_counts(present, edges, bins):
    """{(month, bin): rows}: every row is compared with the edges of its month."""
    spark = present.sparkSession
    table = spark.createDataFrame(list(edges.items()), f"_em {present.schema['_m'].dataType.simpleString()}, _e array<double>")
    joined = present.join(F.broadcast(table), F.col("_m") == F.col("_em"))
    # Edges at or left of the value; the outer two are always met by at least the first.
    passed = sum((F.when(F.col("_x") >= F.get("_e", F.lit(i)), 1).otherwise(0) for i in range(bins + 1)), F.lit(0))
    binned = joined.withColumn("_b", F.least(passed, F.size("_e") - 1))
    counted = binned.groupBy("_m", "_b").agg(F.count("*").alias("n")).collect()
    return {(r["_m"], r["_b"]): r["n"] for r in counted}


def _pair_quantiles(present, ends, base_month, bins, small_group):
    edges = {}
    shares = [i / bins for i in range(bins + 1)]
    for m in ends:
        pair = present.where(F.col("_m").isin([base_month, m]))
        edges[m] = sorted(set(quantiles(pair, ["_x"], shares, (), small_group)[()]["_x"]))
    return edges


def pairwise_psi(df: DataFrame, columns, target="target", bins=10, cuts=None) -> DataFrame:
    """psi_tv, psi_to and psi_vo per numeric feature on the deciles of train, from one counting pass."""
    columns = list(columns)
    cuts = cuts or equal_frequency_cuts(df.where(F.col(target) == "train"), columns, bins)
    parts = {"t": "train", "v": "valid", "o": "oot"}
    wide = df.where(F.col(target).isin(*parts.values())).select(
        F.col(target).alias("_t"), *[bin_number(F.col(f"`{c}`"), cuts[c], "right").alias(c) for c in columns])
    long = wide.unpivot(["_t"], columns, "feature", "bin").where(F.col("bin").isNotNull())
    counted = long.groupBy("feature", "bin").agg(*[F.count_if(F.col("_t") == name).alias(k) for k, name in parts.items()])
    bins_of = edge_frame(df.sparkSession, cuts, with_missing=False).select("feature", "bin")
    dense = bins_of.join(counted, ["feature", "bin"], "left").na.fill(0, list(parts))
    group = Window.partitionBy("feature")
    shares = dense.select("feature", *[
        smooth(F.try_divide(F.col(k), F.sum(k).over(group)), PSI_EPSILON).alias(k) for k in parts])
    listed = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    summed = shares.groupBy("feature").agg(*[
        F.sum(psi_term(b, a)).alias(f"psi_{a}{b}") for a, b in (("t", "v"), ("t", "o"), ("v", "o"))])
    return listed.join(summed, "feature", "left")


def psi_from_distribution(df: DataFrame, score, distribution) -> DataFrame:
    """(psi, n) of scores against a stored ``{bins, counts_good, counts_bad}``; outer edges are opened."""
    edges = list(distribution["bins"])
    edges[0], edges[-1] = -INF, INF
    expected = [g + b for g, b in zip(distribution["counts_good"], distribution["counts_bad"])]
    base = df.sparkSession.createDataFrame(
        [("score", n + 1, int(e)) for n, e in enumerate(expected)], "feature string, bin int, expected bigint")
    counted = df.select(bin_number(F.col(score), edges, "left_highest").alias("bin")).groupBy("bin").agg(
        F.count("*").alias("actual"))
    joined = base.join(counted, "bin", "left").na.fill(0, ["actual"])
    return _terms(joined).agg(F.sum("psi").alias("psi"), F.sum("actual").alias("n"))


def _clipped_psi(actual, expected):
    return psi_term(clip(actual, PSI_EPSILON, 1.0), clip(expected, PSI_EPSILON, 1.0))


def report_psi(df: DataFrame, column="proba", target="target", edges=None) -> DataFrame:
    """Train against out-of-time on the deciles of train: one row (metric, value); 0 without oot rows."""
    edges = edges or equal_frequency_cuts(df.where(F.col(target) == "train"), [column])[column]
    counts = _side_counts(df, {column: edges}, F.col(target) == "train", F.col(target) == "oot", "right_lowest")
    group = Window.partitionBy("feature")
    shares = counts.select(F.try_divide("expected", F.sum("expected").over(group)).alias("e"),
                           F.try_divide("actual", F.sum("actual").over(group)).alias("a"))
    return shares.agg(F.lit("train_vs_oot_psi").alias("metric"),
                      F.coalesce(F.sum(_clipped_psi(F.col("a"), F.col("e"))), F.lit(0.0)).alias("value"))


def report_month_psi(df: DataFrame, column="proba", month_col="month_time", target="target", edges=None) -> DataFrame:
    """(month, psi, is_baseline) on the deciles of train, the earliest month as baseline.

    No rows when there are fewer than two months.
    """
    edges = edges or equal_frequency_cuts(df.where(F.col(target) == "train"), [column])[column]
    bins = len(edges) - 1
    counted = df.where(F.col(month_col).isNotNull()).select(
        F.col(month_col).alias("month"), bin_number(F.col(column), edges, "right_lowest").alias("bin")
    ).where(F.col("bin").isNotNull()).groupBy("month", "bin").agg(F.count("*").alias("n"))
    # One row per month with its bin counts as an array, so empty bins are zeros.
    months = counted.groupBy("month").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("counts"))
    spread = months.select("month", F.transform(
        F.sequence(F.lit(1), F.lit(bins)), lambda b: F.coalesce(F.try_element_at("counts", b), F.lit(0)).cast("double")
    ).alias("counts"))
    total = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x)
    spread = spread.withColumn("shares", F.transform("counts", lambda x: clip(x / total, PSI_EPSILON, 1.0)))
    every = Window.partitionBy(F.lit(1))
    based = spread.withColumns({
        "_first": F.min("month").over(every), "_months": F.count("*").over(every),
        "_base": F.min_by("shares", "month").over(every)})
    psi = F.aggregate(F.zip_with("shares", "_base", lambda a, e: (a - e) * F.ln(a / e)), F.lit(0.0), lambda s, x: s + x)
    return based.where(F.col("_months") > 1).select(
        "month", psi.alias("psi"), (F.col("month") == F.col("_first")).alias("is_baseline"))


def stability_band(psi):
    """``stable`` below 0.1, ``unstable`` above 0.25, ``attention`` between."""
    c = psi if not isinstance(psi, str) else F.col(psi)
    return F.when(c < STABLE_BELOW, "stable").when(c > UNSTABLE_ABOVE, "unstable").when(c.isNotNull(), "attention")
