"""Weight of evidence, information value, lift and KS per bin."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import bin_number, with_infinite_ends
from ..functions.guards import SIMPLE_IV_EPSILON, WOE_EPSILON, finite_or_zero, is_numeric, psi_term, ratio, smooth
from .binning import (bin_counts, edge_frame, equal_frequency_cuts, equal_frequency_edges, grouped_bin_counts,
                      tree_edges)
from .profile import distinct_profile, missing_profile
from .ranks import SMALL_GROUP, quantiles


def woe_from_counts(counts: DataFrame, edges, by=(), closed="right") -> DataFrame:
    """Full bin table from label counts; windows run over the few bins of one feature and group."""
    group = Window.partitionBy("feature", *by)
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = counts.select(
        "feature", *by, "bin", "good", "bad", "total",
        F.sum("good").over(group).alias("_good"), F.sum("bad").over(group).alias("_bad"),
        F.sum("total").over(group).alias("_total"),
        F.sum("good").over(upto).alias("good_cum"), F.sum("bad").over(upto).alias("bad_cum"),
        F.sum("total").over(upto).alias("total_cum"))
    t = t.withColumns({
        "bad_rate": F.try_divide("bad", "total"),
        "good_pct": smooth(F.try_divide("good", "_good"), WOE_EPSILON),
        "bad_pct": smooth(F.try_divide("bad", "_bad"), WOE_EPSILON),
        "total_pct": F.try_divide("total", "_total"),
        "_base": ratio("_bad", "_total"),
        "cum_bad_rate": F.try_divide("bad_cum", "total_cum"),
        "bad_cum_rate": ratio("bad_cum", "_bad"),
        "good_cum_rate": ratio("good_cum", "_good"),
    })
    t = t.withColumns({
        "woe": F.ln(F.col("good_pct") / F.col("bad_pct")),
        "iv": psi_term("good_pct", "bad_pct"),
        "lift": ratio("bad_rate", "_base"),
        "cum_lift": ratio("cum_bad_rate", "_base"),
        "_gap": F.abs(F.col("bad_cum_rate") - F.col("good_cum_rate")),
    })
    t = t.withColumns({"total_iv": F.sum("iv").over(group), "ks": F.max("_gap").over(group)})
    spans = F.broadcast(edge_frame(counts.sparkSession, edges, closed))
    return t.join(spans, ["feature", "bin"]).select(
        "feature", *by, "bin", "low", "high", "bin_range", "good", "bad", "total", "bad_rate", "good_pct", "bad_pct",
        "total_pct", "woe", "iv", "total_iv", "lift", "bad_cum", "total_cum", "cum_bad_rate", "cum_lift",
        "bad_cum_rate", "good_cum_rate", "ks")


def woe_table(df: DataFrame, edges, label="label", by=(), closed="right") -> DataFrame:
    """Bin table of every feature (and group); features with fewer than two bins give no rows."""
    usable = {c: e for c, e in edges.items() if len(e) > 2}
    return woe_from_counts(bin_counts(df, usable, label, by, closed), usable, by, closed)


def woe_detail(df: DataFrame, edges, label="label", quantile_bins=None, small_group=SMALL_GROUP) -> DataFrame:
    """Variant table with KS in percent, chi-square and distributions; missing values are left out.

    Features with only infinite edges fall back to two equal-frequency bins; ``quantile_bins`` asks
    for equal-frequency bins throughout.
    """
    coarse = list(edges) if quantile_bins else [c for c, e in edges.items() if len(e) <= 2]
    edges = dict(edges)
    closed = "right"
    if coarse:
        own = equal_frequency_edges(df, coarse, quantile_bins or 2, (), small_group)[()]
        edges.update({c: [float("-inf")] + e[1:] if len(e) > 1 else e for c, e in own.items()})
    counted = bin_counts(df, edges, label, closed=closed, missing=None)
    group = Window.partitionBy("feature")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = counted.select("feature", "bin", "good", "bad", F.col("labelled").alias("total"),
                       F.sum("good").over(group).alias("_good"), F.sum("bad").over(group).alias("_bad"),
                       F.sum("labelled").over(group).alias("_total"),
                       F.sum("bad").over(upto).alias("_bad_cum"), F.sum("good").over(upto).alias("_good_cum"))
    t = t.withColumns({
        "good_pct": smooth(F.try_divide("good", "_good"), WOE_EPSILON),
        "bad_pct": smooth(F.try_divide("bad", "_bad"), WOE_EPSILON),
        "total_pct": F.try_divide("total", "_total"),
        "bad_rate": F.try_divide("bad", "total"),
        "bad_pct_cumsum": F.try_divide("_bad_cum", "_bad"),
        "good_pct_cumsum": F.try_divide("_good_cum", "_good"),
        "_expected": F.try_divide("_bad", "_total") * F.col("total"),
    })
    t = t.withColumns({
        "ks_pct": F.abs(F.col("bad_pct_cumsum") - F.col("good_pct_cumsum")) * 100,
        "lift": F.try_divide("bad_rate", F.try_divide("_bad", "_total")),
        "chi_square": F.try_divide((F.col("bad") - F.col("_expected")) * (F.col("bad") - F.col("_expected")), "_expected"),
        "woe": F.ln(F.col("good_pct") / F.col("bad_pct")),
        "iv": psi_term("good_pct", "bad_pct"),
        "good_distr": F.try_divide("good", "_total"),
        "bad_distr": F.try_divide("bad", "_total"),
    })
    t = t.withColumn("total_iv", F.sum("iv").over(group))
    spans = F.broadcast(edge_frame(df.sparkSession, edges, closed, with_missing=False))
    return t.join(spans, ["feature", "bin"]).select(
        "feature", "bin", "low", "high", "bin_range", "good", "bad", "total", "good_pct", "bad_pct", "total_pct",
        "bad_rate", "bad_pct_cumsum", "good_pct_cumsum", "ks_pct", "lift", "chi_square", "woe", "iv", "total_iv",
        "good_distr", "bad_distr")


def simple_iv(df: DataFrame, columns, label="label", by=None, bins=10, small_group=SMALL_GROUP, edges=None) -> DataFrame:
    """(feature, [by,] iv) over own equal-frequency bins of every group.

    Text features and groups with one label class get 0.
    """
    keys = [by] if by else []
    numeric = [c for c in columns if is_numeric(df.schema[c].dataType)]
    if edges is None:
        edges = equal_frequency_edges(df, numeric, bins, keys, small_group) if numeric else {}
    groups = list(edges) or ([(r[by],) for r in df.select(by).distinct().collect()] if by else [()])
    listed = [(c, *g) for g in groups for c in columns]
    schema = "feature string" + (f", {by} {df.schema[by].dataType.simpleString()}" if by else "")
    listing = df.sparkSession.createDataFrame(listed, schema)
    # A feature without two edges in any group has no bins at all.
    usable = {c: max((per[c] for per in edges.values()), key=len) for c in numeric if edges}
    usable = {c: e for c, e in usable.items() if len(e) >= 2}
    if not usable:
        return listing.withColumn("iv", F.lit(0.0))

    if by:
        counted = grouped_bin_counts(df, {g: {c: per[c] for c in usable} for g, per in edges.items()}, label, by)
    else:
        counted = bin_counts(df, usable, label, number=lambda c: bin_number(F.col(f"`{c}`"), usable[c], "right_lowest"))
    group = Window.partitionBy("feature", *keys)
    t = counted.withColumn("_b", F.col("bad").cast("double")).withColumn(
        "_g", (F.col("labelled") - F.col("bad")).cast("double"))
    t = t.withColumns({"_gt": F.sum("_g").over(group), "_bt": F.sum("_b").over(group)})
    gp, bp = F.try_divide("_g", "_gt"), F.try_divide("_b", "_bt")
    term = (gp - bp) * F.ln((gp + SIMPLE_IV_EPSILON) / (bp + SIMPLE_IV_EPSILON))
    summed = t.groupBy("feature", *keys).agg(F.sum(term).alias("iv"))
    return listing.join(summed, ["feature", *keys], "left").select(
        "feature", *keys, F.coalesce("iv", F.lit(0.0)).alias("iv"))


def learn_edges(df: DataFrame, columns, label="label", target="target", method="tree", max_leaf_nodes=10,
                min_samples_leaf=0.02, bins=10):
    """Edges learned on the train part only: ``tree`` or ``quantile``."""
    train = df.where(F.col(target) == "train")
    if method == "quantile":
        return equal_frequency_cuts(train, columns, bins)
    return tree_edges(train, columns, label, max_leaf_nodes, min_samples_leaf)


def iv_by_set(df: DataFrame, edges, sets=("train", "valid", "oot"), label="label", target="target") -> DataFrame:
    """One row per feature with ``{set}_iv``; features without a split have 0."""
    table = woe_table(df, edges, label, [target])
    return _wide(df, edges, table, sets, target, "total_iv", "iv")


def ks_by_set(df: DataFrame, edges, sets=("train", "valid", "oot"), label="label", target="target") -> DataFrame:
    """One row per feature with ``{set}_ks`` over the bins; 0 where it cannot be computed."""
    table = woe_table(df, edges, label, [target])
    return _wide(df, edges, table, sets, target, "ks", "ks")


def _wide(df, edges, table, sets, target, column, suffix):
    listed = df.sparkSession.createDataFrame([(c,) for c in edges], "feature string")
    wide = table.groupBy("feature").agg(*[
        F.max(F.when(F.col(target) == s, F.col(column))).alias(f"{s}_{suffix}") for s in sets])
    return listed.join(wide, "feature", "left").select(
        "feature", *[F.coalesce(f"{s}_{suffix}", F.lit(0.0)).alias(f"{s}_{suffix}") for s in sets])


def detail_report(df: DataFrame, edges, part="train", label="label", target="target") -> DataFrame:
    """Bin table of one split, or of all rows together for ``part='all'``."""
    if not any(len(e) > 2 for e in edges.values()):
        raise ValueError("no feature has a split, so there is no bin detail")
    rows = df if part == "all" else df.where(F.col(target) == part)
    return woe_table(rows, edges, label)


def compare_report(df: DataFrame, edges, sets=("train", "valid", "oot"), label="label", target="target",
                   dense=False) -> DataFrame:
    """Per feature and pair of splits: PSI of bin shares, IV difference and its ratio, beside the IVs.

    Bins absent from one side are left out of the PSI unless ``dense``.
    """
    table = woe_table(df, edges, label, [target])
    per_bin = table.groupBy("feature", "bin").agg(*[
        F.max(F.when(F.col(target) == s, F.col(c))).alias(f"{c}_{s}") for s in sets for c in ("total_pct", "total_iv")])
    pairs = [(a, b) for i, a in enumerate(sets) for b in sets[i + 1:]]
    aggregates = []
    for a, b in pairs:
        pa, pb = F.col(f"total_pct_{a}"), F.col(f"total_pct_{b}")
        if dense:
            pa, pb = F.coalesce(pa, F.lit(0.0)), F.coalesce(pb, F.lit(0.0))
        both = F.col(f"total_iv_{a}").isNotNull() & F.col(f"total_iv_{b}").isNotNull()
        gap = F.when(both, F.col(f"total_iv_{a}") - F.col(f"total_iv_{b}"))
        aggregates += [
            F.coalesce(F.sum(psi_term(smooth(pa, WOE_EPSILON), smooth(pb, WOE_EPSILON))), F.lit(0.0)).alias(f"{a}_{b}_psi"),
            F.max(gap).alias(f"{a}_{b}_iv_diff"),
            F.max(F.try_divide(gap, F.col(f"total_iv_{a}"))).alias(f"{a}_{b}_iv_diff_ratio"),
        ]
    compared = per_bin.groupBy("feature").agg(*aggregates)
    return _wide(df, edges, table, sets, target, "total_iv", "iv").join(compared, "feature", "left")


def feature_report(df: DataFrame, columns, label="label") -> DataFrame:
    """IV, missing rate, type and distinct count per feature, highest IV first."""
    kinds = df.sparkSession.createDataFrame([(c, dict(df.dtypes)[c]) for c in columns], "feature string, data_type string")
    missing = missing_profile(df, columns).select(F.col("column_name").alias("feature"), "missing_rate")
    distinct = distinct_profile(df, columns).select(F.col("column_name").alias("feature"), "n_distinct")
    joined = kinds.join(simple_iv(df, columns, label), "feature").join(missing, "feature").join(
        distinct, "feature", "left")
    return joined.select(
        "feature", F.round("iv", 6).alias("iv"), F.round("missing_rate", 4).alias("missing_rate"), "data_type",
        F.coalesce("n_distinct", F.lit(0)).alias("n_distinct")).orderBy(F.desc("iv"), "feature")


def multi_set_metrics(df: DataFrame, columns, label="label", target="target", sets=("train", "valid", "oot"),
                      iv_method="simple", bins=10) -> DataFrame:
    """One row per feature: ``iv_{set}`` and PSI between the splits (train deciles); NaN and inf are 0.

    iv_method: ``simple`` bins every split by its own deciles, ``tree`` by edges learned on train.
    """
    from .psi import pairwise_psi

    columns = [c for c in columns if c in df.columns]
    numeric = [c for c in columns if is_numeric(df.schema[c].dataType)]
    cuts = None
    if iv_method == "tree":
        wide = iv_by_set(df, learn_edges(df, numeric, label, target), sets, label, target)
        wide = wide.withColumnsRenamed({f"{s}_iv": f"iv_{s}" for s in sets})
    else:
        scope = df.where(F.col(target).isin(*sets))
        # One set of quantiles serves both: all of them bin a split for its IV, the inner ones of train
        # carry the PSI.
        found = quantiles(scope, numeric, [i / bins for i in range(bins + 1)], [target]) if numeric else {}
        edges = {g: {c: sorted(set(v)) if v else [] for c, v in per.items()} for g, per in found.items()}
        if ("train",) in found:
            cuts = {c: with_infinite_ends((v or [])[1:-1]) for c, v in found[("train",)].items()}
        own = simple_iv(scope, columns, label, target, bins, edges=edges)
        wide = own.groupBy("feature").agg(*[
            F.max(F.when(F.col(target) == s, F.col("iv"))).alias(f"iv_{s}") for s in sets])
    listed = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    joined = listed.join(wide, "feature", "left").join(
        pairwise_psi(df, numeric, target, bins, cuts), "feature", "left")
    return joined.select("feature", *[finite_or_zero(c).alias(c) for c in joined.columns if c != "feature"])


def total_iv(table: DataFrame, by=()) -> DataFrame:
    """Summary row of a bin table."""
    return table.groupBy("feature", *by).agg(F.sum("iv").alias("total_iv"), F.count("*").alias("n_bins"))
