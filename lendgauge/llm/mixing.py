"""Mixing sources to target weights by Pareto order sampling.

A source with S words and a target of T words is taken T / S times over. Documents prefer their grade: expected copies are
in proportion to it, up to the cap. The whole part of the expected copies is certain. For the rest, documents are ranked by
the odds of a random number divided by the odds of their inclusion, and taken in that order until the words of the target are
reached. Only DataFrame functions are used.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED = 17
#: Copies of a document at most.
CAP = 3
#: Buckets of ranks per source. Sums per bucket find the one that holds the cut; only its rows are ordered.
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    """Column: number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def grade(size):
    """Column: preference of a document, the number of binary digits of its size; 1 to 63."""
    return F.length(F.bin(size)).cast("int")


def cycled_weights(sources: DataFrame, weights=(1, 2, 3)) -> DataFrame:
    """Sources of a small table with ``weights`` in turn, by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights)))


def targets(sources: DataFrame, cap=CAP, total=None) -> DataFrame:
    """Targets in words for a small table of source, source_size, weight.

    Sources share ``total`` words (all there are by default) by weight; a target stops at ``cap`` times its source's size and
    the excess is shared again by weight until none is above. Sources in order of cap / weight fill one after the other, so
    the level all others reach is the first that stays below the next source's own.
    """
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    limit = F.col("source_size") * cap
    wanted = F.lit(float(total)) if total is not None else F.sum("source_size").over(whole).cast("double")
    level = (wanted - F.coalesce(F.sum(limit).over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = sources.withColumn("__level", level).withColumn("__open", F.col("__level") * F.col("weight") <= limit)
    found = F.min(F.when(F.col("__open"), F.struct(F.col("source_size") / F.col("weight"), "source", "__level"))).over(whole)["__level"]
    reached = F.least(limit.cast("double"), F.coalesce(found * F.col("weight"), limit.cast("double")))
    return levels.withColumn("target", F.round(reached, 6)).drop("__level", "__open")


def cells(sized: DataFrame, weights=(1, 2, 3), cap=CAP, total=None) -> DataFrame:
    """Small table per source and grade: source, grade, source_size, target, certain (copies), share (of a further one), rest (words).

    Expected copies are ``min(cap, c * grade)`` with one c per source; c follows from the grades in falling order as the
    level does for targets.
    """
    counts = sized.groupBy("source", "grade").agg(F.sum("size").alias("words"))
    sources = counts.groupBy("source").agg(F.sum("words").alias("source_size"))
    goals = targets(cycled_weights(sources, weights), cap, total)
    joined = counts.join(goals, counts.source.eqNullSafe(goals.source)).drop(goals.source)
    own = Window.partitionBy("source")
    falling = own.orderBy(F.col("grade").desc())
    before = falling.rowsBetween(Window.unboundedPreceding, -1)
    weighted = F.col("grade") * F.col("words")
    # No level where the grades that are left have no words.
    level = F.try_divide(F.col("target") - cap * F.coalesce(F.sum("words").over(before), F.lit(0)),
                         F.sum(weighted).over(own) - F.coalesce(F.sum(weighted).over(before), F.lit(0)))
    levels = joined.withColumn("__level", level).withColumn("__open", F.col("__level") * F.col("grade") <= cap)
    found = F.max(F.when(F.col("__open"), F.struct("grade", "__level"))).over(own)["__level"]
    copies = F.round(F.least(F.lit(float(cap)), F.coalesce(found * F.col("grade"), F.lit(float(cap)))), 9)
    certain = F.floor("copies").cast("bigint")
    return (levels.withColumn("copies", copies).withColumn("certain", certain)
            .withColumn("rest", F.col("target") - F.sum(certain * F.col("words")).over(own))
            .select("source", "grade", "source_size", "target", "certain", (F.col("copies") - certain).alias("share"), "rest"))


def ranked(sized: DataFrame, table: DataFrame, id="doc_id", seed=SEED) -> DataFrame:
    """``sized`` with its cell and ``__rank``, the document's place from 0 to 1 in the order of odds; null without a share."""
    table = table.select(F.col("source").alias("__source"), F.col("grade").alias("__grade"), "source_size", "target", "certain",
                         "share", "rest")
    known = sized.join(table, sized.source.eqNullSafe(F.col("__source")) & (sized.grade == F.col("__grade"))).drop("__source", "__grade")
    text = F.concat_ws("|", F.lit(str(seed)), F.col(id).cast("string"), F.col("source"), F.col("size").cast("string"))
    u = (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    odds = F.try_divide(u / (1 - u), F.col("share") / (1 - F.col("share")))
    return known.withColumn("__rank", F.when((F.col("share") > 0) & (F.col("size") > 0), odds / (1 + odds)))


def cuts(placed: DataFrame, buckets=BUCKETS) -> DataFrame:
    """Small table: source, cut: the last rank that is taken, so that the words taken come nearest to the source's rest.

    Rows without a rank have no part. Rows of one rank are taken together or not at all.
    """
    bucket = F.floor(F.col("__rank") * buckets)
    # Equal ranks are one row from here on.
    ranks = placed.where(F.col("__rank").isNotNull()).select("source", "rest", "size", bucket.alias("bucket"), "__rank")
    sums = ranks.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy("bucket")
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spread = sums.withColumn("before", before)
    crossed = spread.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
    # Where all ranked words together stay below the rest, all are taken.
    short = (spread.groupBy("source").agg(F.sum("words").alias("words"), F.first("rest").alias("rest"))
             .where(F.col("words") < F.col("rest")).select("source", F.lit(1.0).alias("cut")))
    edge = crossed.select(F.col("source").alias("__source"), F.col("bucket").alias("__bucket"), "before")
    inside = (ranks.join(edge, ranks.source.eqNullSafe(F.col("__source")) & (ranks.bucket == F.col("__bucket")))
              .groupBy("source", "bucket", "__rank").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"),
                                                         F.first("before").alias("before")))
    within = Window.partitionBy("source").orderBy("__rank")
    after = F.col("before") + F.sum("size").over(within)
    near = inside.withColumn("after", after).where(
        (F.col("after") <= F.col("rest")) | (F.col("after") - F.col("rest") < F.col("rest") - (F.col("after") - F.col("size"))))
    # A bucket none of whose rows is taken still has those before it.
    found = (edge.join(near.groupBy("source").agg(F.max("__rank").alias("cut")), F.col("__source").eqNullSafe(F.col("source")), "left")
             .select(F.col("__source").alias("source"), F.coalesce("cut", F.col("__bucket") / buckets - 2.0 ** -40).alias("cut")))
    return found.unionByName(short)


def mix(sized: DataFrame, plan_of=None, weights=(1, 2, 3), cap=CAP, total=None, id="doc_id", seed=SEED, buckets=BUCKETS) -> DataFrame:
    """``sized`` (with source, size, grade and an id) with source_size, target and ``copies`` of each document.

    ``plan_of`` may be a slimmer table of the same rows to plan from (default: ``sized``). Decisions depend on id, source,
    size and seed alone, so reruns agree and rows equal in those are treated alike. A null source is a source; a null id is
    a value. Documents without words are not taken.
    """
    plan_of = sized if plan_of is None else plan_of
    table = cells(plan_of, weights, cap, total)
    limits = cuts(ranked(plan_of, table, id, seed), buckets).select(F.col("source").alias("__cut_source"), "cut")
    placed = ranked(sized, table, id, seed)
    picked = F.coalesce(F.col("__rank") <= F.col("cut"), F.lit(False)).cast("bigint")
    return (placed.join(limits, placed.source.eqNullSafe(F.col("__cut_source")), "left")
            .withColumn("copies", F.when(F.col("size") > 0, F.col("certain") + picked).otherwise(F.lit(0).cast("bigint")))
            .drop("__rank", "__cut_source", "cut", "certain", "share", "rest"))
