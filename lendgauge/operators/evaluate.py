"""Model quality: KS, AUC, lift, score tables and data summaries."""

import math
from collections import defaultdict
from functools import partial, reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import in_task
from ..functions.bins import bin_number
from ..functions.guards import ratio
from .binning import equal_frequency_edges, equal_width_edges
from .ranks import SMALL_GROUP, quantiles

# The published top shares in percent.
TOP_PERCENTS = [1, 2, 3, 5, 10, 20]
#: Rows that a task sorts into a block of scores at a time, scores of a block between those that tell where to cut, least scores of a piece.
BLOCK_ROWS, STEP, LEAST_PIECE = 1 << 19, 4096, 50_000
#: Groups that are told apart by comparisons; more are joined.
FEW_GROUPS = 32
FIGURES = [T.StructField("ks", T.DoubleType()), T.StructField("auc", T.DoubleType())]


def ks_auc(df: DataFrame, by=(), score="proba", label="label", weight=None, small_group=SMALL_GROUP,
           digits=None, groups=None) -> DataFrame:
    """(*by, ks, auc) of a bad-probability, optionally weighted.

    Rows with equal scores are summed first, so ties count half in the AUC. A group with one label
    class has KS 0 and AUC 0.5. ``digits`` rounds the score before grouping to bound the number of
    distinct scores; without it the result is exact. ``groups``, the rows of ``by`` values, may be handed in.

    Scores are computed once and kept as sorted blocks of bytes. Cuts taken from the blocks deal them into pieces
    of about ``small_group`` distinct scores at most; a piece is ordered by one task, and seven numbers of it come back.
    """
    keys, spark = list(by), df.sparkSession
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    s = F.col(score).cast("double")
    if digits is not None:
        s = F.round(s, digits)
    if keys:
        # Before scores are computed, so that they aren't for this.
        groups = groups if groups is not None else df.select(*keys).distinct().collect()
        if len(groups) <= FEW_GROUPS and all(isinstance(v, (str, int, type(None))) for r in groups for v in r):
            of_group = [reduce(lambda x, y: x & y, [F.col(f"`{k}`").eqNullSafe(F.lit(v)) for k, v in zip(keys, r)]) for r in groups]
            df = df.withColumn("_k", F.coalesce(*[F.when(x, n) for n, x in enumerate(of_group)], F.lit(None).cast("int"))).where("_k IS NOT NULL")
        else:
            schema = T.StructType([T.StructField("_k", T.IntegerType()), *[T.StructField(f"_g{i}", df.schema[k].dataType) for i, k in enumerate(keys)]])
            numbered = spark.createDataFrame([(n, *r) for n, r in enumerate(groups)], schema)
            df = df.join(F.broadcast(numbered), [df[k].eqNullSafe(numbered[f"_g{i}"]) for i, k in enumerate(keys)])
    else:
        groups, df = [()], df.withColumn("_k", F.lit(0))
    of_label = lambda value: F.coalesce(F.when(F.col(label) == value, w), F.lit(0.0))
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col("_k").alias("k"), s.alias("s"), of_label(0).alias("g"), of_label(1).alias("b"))
    blocks = rows.mapInArrow(partial(in_task.score_blocks, most=BLOCK_ROWS), "k int, s binary, g binary, b binary")
    blocks = blocks.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        step = max(1, min(STEP, small_group // 16))
        sizes, totals, points = defaultdict(int), {}, defaultdict(list)
        for k, n, good, bad, some in blocks.map(partial(in_task.block_facts, step=step)).collect():
            sizes[k] += n
            totals[k] = tuple(x + y for x, y in zip(totals.get(k, (0.0, 0.0)), (good, bad)))
            points[k].append(np.frombuffer(some))
        if not sizes:
            return spark.createDataFrame([], T.StructType([*[df.schema[k] for k in keys], *FIGURES]))
        share = min(small_group, max(sum(sizes.values()) // spark.sparkContext.defaultParallelism, LEAST_PIECE))
        cuts, places, last, held = {}, {}, 0, 0
        for k, n in sizes.items():
            pieces = math.ceil(n / share)
            own = np.sort(np.concatenate(points[k]))
            cuts[k] = np.unique(own[[len(own) * i // pieces for i in range(1, pieces)]])
            cuts[k], places[k] = cuts[k][~np.isnan(cuts[k])], []
            for _ in range(len(cuts[k]) + 1):
                # Small pieces share a task.
                if held and held + n / pieces > share:
                    last, held = last + 1, 0
                places[k].append(last)
                held += n / pieces
        dealt = blocks.flatMap(partial(in_task.cut_block, cuts=cuts, places=places)).partitionBy(last + 1, lambda place: place)
        found = defaultdict(list)
        for k, *figures in sorted(dealt.mapPartitions(partial(in_task.rate_pieces, totals=totals)).collect()):
            found[k].append(figures)
    finally:
        blocks.unpersist()
    measured = [(*groups[k], *_joined_pieces(pieces, *totals[k])) for k, pieces in found.items()]
    return spark.createDataFrame(measured, T.StructType([*[df.schema[k] for k in keys], *FIGURES]))


def _joined_pieces(pieces, good, bad):
    """KS and AUC of a group from its pieces (number, goods, bads, pairs in order, highest and lowest gap) in ascending order."""
    if not good or not bad:
        return 0.0, 0.5
    ks = area = goods = bads = 0.0
    for _, g, b, inside, high, low in pieces:
        before = goods / good - bads / bad
        ks = float(np.max(np.abs([ks, before + high, before + low])))
        area += inside + b * goods
        goods, bads = goods + g, bads + b
    return ks, area / (good * bad)


def _by_split_and_month(df, score, label, target, month, sets):
    """(section, datasets, score, label): every row once for its split and once for its month."""
    keys = [F.struct(F.lit("split").alias("section"), F.when(F.col(target).isin(*sets), F.col(target)).alias("datasets"))]
    if month in df.columns:
        keys.append(F.struct(F.lit("month").alias("section"), F.col(month).alias("datasets")))
    rows = df.select(F.explode(F.array(*keys)).alias("k"), F.col(score).alias("proba"), F.col(label).alias("label"))
    return rows.select("k.section", "k.datasets", "proba", "label").where(F.col("datasets").isNotNull())


def _with_several_months(result):
    """Drop the month rows when there is only one month."""
    months = F.count_if(F.col("section") == "month").over(Window.partitionBy(F.lit(1)))
    return result.withColumn("_n", months).where((F.col("section") != "month") | (F.col("_n") > 1)).drop("_n", "section")


def performance(df: DataFrame, score="proba", label="label", target="target", month="month_time",
                sets=("train", "valid", "oot"), small_group=SMALL_GROUP) -> DataFrame:
    """(datasets, auc, ks) per split, and per month when there are at least two months, from one pass."""
    rows = _by_split_and_month(df, score, label, target, month, sets)
    found = ks_auc(rows, ["section", "datasets"], "proba", "label", None, small_group)
    return _with_several_months(found.select("section", "datasets", "auc", "ks"))


def top_lift(df: DataFrame, by, score="proba", label="label", percents=TOP_PERCENTS, small_group=SMALL_GROUP):
    """Per group the bad rate among the top n percent of scores over the group's bad rate."""
    rows = df.where(F.col(by).isNotNull())
    shares = [1 - n / 100 for n in percents]
    found = quantiles(rows, [score], shares, [by], small_group)
    schema = T.StructType([T.StructField("_g", df.schema[by].dataType)]
                          + [T.StructField(f"_t{n}", T.DoubleType()) for n in percents])
    table = [(g[0], *(v[score] or [None] * len(percents))) for g, v in found.items()]
    cuts = F.broadcast(df.sparkSession.createDataFrame(table, schema))
    joined = rows.join(cuts, F.col(by) == F.col("_g"))
    lifted = joined.groupBy(by).agg(
        F.avg(label).alias("_base"),
        *[F.avg(F.when(F.col(score) >= F.col(f"_t{n}"), F.col(label))).alias(f"_top{n}") for n in percents])
    return lifted.select(F.col(by).alias("datasets"), *[
        ratio(f"_top{n}", "_base").alias(f"top_{n}_lift") for n in percents])


def performance_table(df: DataFrame, score="proba", label="label", target="target", month="month_time",
                      sets=("train", "valid", "oot"), small_group=SMALL_GROUP) -> DataFrame:
    """KS and AUC beside the top-share lifts, per split and month."""
    rows = _by_split_and_month(df, score, label, target, month, sets)
    found = ks_auc(rows, ["section", "datasets"], "proba", "label", None, small_group)
    lifts = top_lift(rows, "datasets", "proba", "label", small_group=small_group)
    return _with_several_months(found.select("section", "datasets", "auc", "ks")).join(F.broadcast(lifts), "datasets", "left")


def score_ks_table(df: DataFrame, score="score", label="label", buckets=10, by=None, small_group=SMALL_GROUP):
    """([by,] bucket, min, max, bad_rate, total_prop, cum_bad_rate, cum_total_prop), low scores first.

    Buckets are equal-frequency per group; ``min`` and ``max`` are their true edges.
    """
    keys = [by] if by else []
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    edges = equal_frequency_edges(rows, [score], buckets, keys, small_group)
    parts, spans = [], []
    for group, per in edges.items():
        e = per[score]
        if not e:
            continue
        if len(e) == 1:
            e = [e[0], e[0]]
        spans += [(*group, n, e[n - 1], e[n]) for n in range(1, len(e))]
        chosen = F.col(by).eqNullSafe(F.lit(group[0])) if by else F.lit(True)
        parts.append((chosen, bin_number(F.col(score), e, "right_lowest")))
    if not spans:
        schema = ([f"{by} {df.schema[by].dataType.simpleString()}"] if by else []) + ["bucket int"] + [
            f"{c} double" for c in ("min", "max", "bad_rate", "total_prop", "cum_bad_rate", "cum_total_prop")]
        return df.sparkSession.createDataFrame([], ", ".join(schema))
    bucket = reduce(lambda rest, part: F.when(part[0], part[1]).otherwise(rest), parts, F.lit(None).cast("int"))
    counted = rows.groupBy(*keys, bucket.alias("bucket")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("bad"))
    schema = ([f"{by} {df.schema[by].dataType.simpleString()}"] if by else []) + ["bucket int", "min double", "max double"]
    joined = counted.join(F.broadcast(df.sparkSession.createDataFrame(spans, ", ".join(schema))), [*keys, "bucket"])
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n").over(group)
    return joined.select(
        *keys, "bucket", "min", "max", (F.col("bad") / F.col("n")).alias("bad_rate"),
        (F.col("n") / total).alias("total_prop"),
        (F.sum("bad").over(upto) / F.sum("n").over(upto)).alias("cum_bad_rate"),
        (F.sum("n").over(upto) / total).alias("cum_total_prop"))


LIFT_COLUMNS = ("min", "max", "bad_rate", "total_prop", "cum_bad_rate", "cum_total_prop")


def lift_table(df: DataFrame, score="score", label="label", target="target", sets=("train", "valid", "oot"),
               buckets=10, small_group=SMALL_GROUP) -> DataFrame:
    """Score tables of the splits side by side on the bucket number; also the score cut-off table."""
    table = score_ks_table(df.where(F.col(target).isin(*sets)), score, label, buckets, target, small_group)
    return table.groupBy("bucket").agg(*[
        F.max(F.when(F.col(target) == s, F.col(c))).alias(f"{s}_{c}") for s in sets for c in LIFT_COLUMNS])


def data_summary(df: DataFrame, label="label", target="target", month="month_time", weight="weight") -> DataFrame:
    """(section, dataset, count, badrate, badrate_weight, month_min, month_max) for all rows, per split
    and per month from one aggregation. Months are listed only when there are at least two."""
    rows = df.select(F.col(target).alias("_t"), F.col(month).alias("_m"), F.col(label).alias("_y"),
                     (F.col(label) * F.col(weight)).alias("_wy"), F.col(weight).alias("_w"), F.col(month).alias("_time"))
    grouped = rows.groupingSets([[], ["_t"], ["_m"]], "_t", "_m").agg(
        F.grouping("_t").alias("_gt"), F.grouping("_m").alias("_gm"),
        F.count("_y").alias("count"), F.avg("_y").alias("badrate"),
        F.try_divide(F.sum("_wy"), F.sum("_w")).alias("badrate_weight"),
        F.min("_time").alias("month_min"), F.max("_time").alias("month_max"))
    section = F.when((F.col("_gt") == 1) & (F.col("_gm") == 1), "all").when(F.col("_gm") == 1, "split").otherwise("month")
    named = grouped.withColumn("section", section).withColumn(
        "dataset", F.when(F.col("section") == "all", "all").otherwise(F.coalesce("_t", "_m")))
    named = named.where(F.col("dataset").isNotNull())
    months = F.sum(F.when(F.col("section") == "month", 1).otherwise(0)).over(Window.partitionBy(F.lit(1)))
    named = named.withColumn("_months", months).where((F.col("section") != "month") | (F.col("_months") > 1))
    spread = (F.col("section") != "all") | (F.col("_months") > 1)
    return named.select("section", "dataset", "count", "badrate", "badrate_weight",
                        F.when(spread, F.col("month_min")).alias("month_min"),
                        F.when(spread, F.col("month_max")).alias("month_max"))


def score_distribution(df: DataFrame, score="score", label="label", bins=20) -> DataFrame:
    """One row {bins, counts_good, counts_bad, avg_good, avg_bad} over equal-width bins of all scores."""
    edges = equal_width_edges(df, [score], bins)[score]
    number = bin_number(F.col(score), edges, "left_highest")
    counted = df.groupBy(number.alias("bin")).agg(
        F.count_if(F.col(label) == 0).alias("good"), F.count_if(F.col(label) == 1).alias("bad"),
        F.sum(F.when(F.col(label) == 0, F.col(score))).alias("sum_good"),
        F.sum(F.when(F.col(label) == 1, F.col(score))).alias("sum_bad"))
    whole = counted.agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "good"))).alias("good_map"),
        F.map_from_entries(F.collect_list(F.struct("bin", "bad"))).alias("bad_map"),
        ratio(F.sum("sum_good"), F.sum("good")).alias("avg_good"), ratio(F.sum("sum_bad"), F.sum("bad")).alias("avg_bad"))
    numbers = F.array(*[F.lit(i) for i in range(1, bins + 1)])

    def spread(name):
        return F.transform(numbers, lambda b: F.coalesce(F.try_element_at(name, b), F.lit(0)))

    return whole.select(F.array(*[F.lit(e) for e in edges]).alias("bins"), spread("good_map").alias("counts_good"),
                        spread("bad_map").alias("counts_bad"), "avg_good", "avg_bad")


def score_histogram(df: DataFrame, score="score", bins=10) -> DataFrame:
    """One row: sample size, mean, min, max, population std, and an equal-width histogram."""
    ends = df.agg(F.min(score).alias("low"), F.max(score).alias("high")).first()
    if ends["low"] is None:
        raise ValueError("there is no score to describe")
    edges = equal_width_edges(df, [score], bins)[score]
    number = bin_number(F.col(score), edges, "left_highest")
    per_bin = [F.count_if(F.col("_bin") == b) for b in range(1, bins + 1)]
    return df.where(F.col(score).isNotNull()).select(F.col(score).alias("_s"), number.alias("_bin")).agg(
        F.count("*").alias("sample_size"), F.avg("_s").alias("avg_score"), F.min("_s").alias("min_score"),
        F.max("_s").alias("max_score"), F.stddev_pop("_s").alias("std_score"),
        F.array(*per_bin).alias("counts")).withColumn("bins", F.array(*[F.lit(e) for e in edges]))
