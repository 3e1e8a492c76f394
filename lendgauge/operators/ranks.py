"""Exact order statistics and running totals without sorting a large group in one task.

``quantiles`` counts the distinct values of large groups and orders only those near the wanted ranks.

``order_statistics`` narrows every wanted rank to a small open interval: an
approximate sketch proposes the interval, exact counts below and inside it confirm it, and only
when few rows are left are their distinct values looked at. Each round is one aggregation with
map-side combining; no row is shuffled until the interval is small.

``running_totals`` splits every group at sketch quantiles into buckets, sums inside the buckets and
adds the total of the buckets before. The cuts only decide how the work is spread, never the sums.
"""

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Groups up to this many values may be held by one task.
SMALL_GROUP = 1_000_000
# Values of all columns together that a task may hold.
TASK_VALUES = 4_000_000
# The built-in percentile walks the values of a group once for every probability: so many steps are left to it.
TASK_STEPS = 1_000_000
GRID = 200
SKETCH_ACCURACY = 10_000
MAX_BUCKETS = 1024


def unpivot_numeric(df: DataFrame, keys, columns, name="feature", value="value"):
    """Long form of numeric columns as doubles."""
    picked = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return picked.unpivot(list(keys), list(columns), name, value)


# ---------------------------------------------------------------- quantiles

def quantiles(df: DataFrame, columns, probabilities, by=(), small_group=SMALL_GROUP):
    """Exact linearly interpolated quantiles: ``{group: {column: [values]}}``.

    ``group`` is the tuple of the ``by`` values, ``()`` without grouping. Columns without any value
    give None. The result holds groups x columns x probabilities numbers.
    """
    by, columns = list(by), list(columns)
    sizes = df.groupBy(*by).agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)]).collect()
    counts = {tuple(r[k] for k in by): {c: r[f"n{i}"] for i, c in enumerate(columns)} for r in sizes}
    largest = max((n for group in counts.values() for n in group.values()), default=0)
    if largest <= small_group and largest * len(probabilities) <= TASK_STEPS:
        # A task holds the values of a group in all columns it is asked for: few enough of them at a time.
        width = max(TASK_VALUES // max(largest, 1), 1)
        result = {group: {} for group in counts}
        for start in range(0, len(columns), width):
            for group, found in _quantiles_in_memory(df, columns[start:start + width], probabilities, by).items():
                result[group].update(found)
        return result

    wanted = {}
    for group, per_column in counts.items():
        for c, n in per_column.items():
            if n:
                wanted[group + (c,)] = n, sorted({r for p in probabilities for r in _neighbours(p, n)})
    found = _ranked_values(unpivot_numeric(df, by, columns), [*by, "feature"], wanted, small_group) if wanted else {}
    return {
        group: {c: [_interpolate(found[group + (c,)], p, n) for p in probabilities] if n else None for c, n in per_column.items()}
        for group, per_column in counts.items()}


def _ranked_values(long, keys, wanted, small_group):
    """``{key: {rank: value}}`` of ``wanted = {key: (rows, [ranks])}``, from running counts over the distinct values.

    The values of a key are dealt to buckets at sketch quantiles. Rows per bucket tell which buckets hold a wanted rank, and only the
    values of those are shuffled and ordered. The cuts decide how much that is, never the result.
    """
    spark, rows = long.sparkSession, long.where(F.col("value").isNotNull())
    kinds = [T.StructField(f"_w{i}", rows.schema[k].dataType) for i, k in enumerate(keys)]
    most, asked = max(n for n, _ in wanted.values()), max(len(ranks) for _, ranks in wanted.values())
    buckets = min(MAX_BUCKETS, 2 ** math.ceil(math.log2(max(8 * asked, 4 * most / small_group))))
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    counted = rows.groupBy(*keys, "value").agg(F.count("*").alias("_n")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # Keys x buckets numbers; NaN would part the search.
        cuts = {tuple(r)[:-1]: sorted({c for c in r["_cuts"] if not math.isnan(c)})
                for r in counted.groupBy(*keys).agg(F.percentile_approx("value", shares, F.lit(10 * buckets)).alias("_cuts")).collect()}
        totals = {}
        for r in _bucketed(counted, keys, kinds, buckets, cuts).groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_n")).collect():
            totals.setdefault(tuple(r)[:-2], []).append((r["_bucket"], r["_n"]))
        inner = []
        for key, (_, ranks) in wanted.items():
            ranks, at, before = sorted(ranks), 0, 0
            for bucket, n in sorted(totals[key]):
                while at < len(ranks) and ranks[at] < before + n:
                    inner.append((*key, bucket, ranks[at] - before, ranks[at]))
                    at += 1
                before += n
        places = spark.createDataFrame(inner, T.StructType(
            [*kinds, *[T.StructField(c, t) for c, t in (("_b", T.IntegerType()), ("_local", T.LongType()), ("_rank", T.LongType()))]]))
        of_bucket = lambda df: [*[df[k].eqNullSafe(places[f"_w{i}"]) for i, k in enumerate(keys)], df["_bucket"].eqNullSafe(places["_b"])]
        dealt = _bucketed(counted, keys, kinds, buckets, cuts)
        inside = dealt.join(F.broadcast(places), of_bucket(dealt), "left_semi")
        upto = Window.partitionBy(*keys, "_bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ended = inside.withColumn("_end", F.sum("_n").over(upto))
        met = ended.join(F.broadcast(places), of_bucket(ended)).where("_local >= _end - _n AND _local < _end")
        found = {key: {} for key in wanted}
        for r in met.select(*keys, "_rank", "value").collect():
            found[tuple(r)[:-2]][r["_rank"]] = r["value"]
        return found
    finally:
        counted.unpersist()


def _bucketed(counted, keys, kinds, buckets, cuts):
    """``counted`` with the number of its key's ``cuts`` (fewer than ``buckets``) below the value as ``_bucket``."""
    table = counted.sparkSession.createDataFrame(
        [(*key, own) for key, own in cuts.items()], T.StructType([*kinds, T.StructField("_cuts", T.ArrayType(T.DoubleType()))]))
    df = counted.join(F.broadcast(table), [counted[k].eqNullSafe(table[f"_w{i}"]) for i, k in enumerate(keys)]).withColumn("_bucket", F.lit(0))
    step = buckets // 2
    while step:
        # Binary search: skip ``step`` cuts when the last of them lies left of the value.
        moves = F.get("_cuts", F.col("_bucket") + (step - 1)) < F.col("value")
        df = df.withColumn("_bucket", F.col("_bucket") + F.when(moves, step).otherwise(0))
        step //= 2
    return df.select(*keys, "value", "_n", "_bucket")


def _quantiles_in_memory(df, columns, probabilities, by):
    grid = F.array(*[F.lit(float(p)) for p in probabilities])
    rows = df.groupBy(*by).agg(
        *[F.percentile(F.col(f"`{c}`").cast("double"), grid).alias(f"q{i}") for i, c in enumerate(columns)]
    ).collect()
    return {
        tuple(r[k] for k in by): {c: (list(r[f"q{i}"]) if r[f"q{i}"] is not None else None)
                                  for i, c in enumerate(columns)}
        for r in rows
    }


def _neighbours(p, n):
    position = p * (n - 1)
    return math.floor(position), math.ceil(position)


def _interpolate(values, p, n):
    """As the built-in percentile does to the last bit, so that the way a quantile is found never shows."""
    low, high = _neighbours(p, n)
    a, b, position = values[low], values[high], p * (n - 1)
    return a if low == high or a == b else (high - position) * a + (position - low) * b


# ---------------------------------------------------------------- ranks

def order_statistics(df: DataFrame, value, wanted, keys=(), small_group=SMALL_GROUP, sizes=None):
    """Exact values at 0-based ranks: ``{key: {rank: value}}`` for ``wanted = {key: [ranks]}``.

    Nulls in ``value`` are not ranked. Any orderable numeric or time type works and keeps its type.
    """
    keys = list(keys)
    if keys:
        rows = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("_x"))
    else:
        rows = df.select(F.lit(0).alias("_k0"), F.col(value).alias("_x"))
    rows = rows.where(F.col("_x").isNotNull())
    names = [c for c in rows.columns if c != "_x"]
    if sizes is None:
        sizes = {tuple(r[k] for k in names) if keys else (): r["n"]
                 for r in rows.groupBy(*names).agg(F.count("*").alias("n")).collect()}
    spark, kind = df.sparkSession, rows.schema["_x"].dataType
    key_fields = [rows.schema[k] for k in names]

    found = {key: {} for key in wanted}
    # An interval is (key, low, high, rows inside, [(rank in the group, rank inside)], halve); ends are open.
    pending = [(key, None, None, sizes.get(key, 0), [(r, r) for r in ranks], False)
               for key, ranks in wanted.items() if ranks]
    while pending:
        small = [i for i in pending if i[3] <= small_group]
        large = [i for i in pending if i[3] > small_group]
        if small:
            _look_up(_inside(spark, rows, names, key_fields, kind, small), small, found)
        pending = _narrow(spark, rows, names, key_fields, kind, large, found) if large else []
    return found


def _inside(spark, rows, names, key_fields, kind, intervals, extra=None):
    """Rows joined with the intervals of their key. The interval table has one row per wanted rank."""
    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in key_fields]
        + [T.StructField("_i", T.IntegerType()), T.StructField("_low", kind), T.StructField("_high", kind)]
    )
    data = [(tuple(i[0]) or (0,)) + (n, i[1], i[2]) for n, i in enumerate(intervals)]
    table = F.broadcast(spark.createDataFrame(data, schema))
    matched = [rows[k].eqNullSafe(table[k]) for k in names]
    joined = rows.join(table, matched, "inner").select("_i", "_low", "_high", "_x")
    return joined.where(
        (F.col("_low").isNull() | (F.col("_x") > F.col("_low")))
        & (F.col("_high").isNull() | (F.col("_x") < F.col("_high")))
    )


def _look_up(inside, intervals, found):
    counted = inside.groupBy("_i", "_x").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_i").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    covered = counted.withColumn("_end", F.sum("_n").over(upto)).withColumn("_start", F.col("_end") - F.col("_n"))
    ranks = inside.sparkSession.createDataFrame(
        [(n, local, rank) for n, i in enumerate(intervals) for rank, local in i[4]], "_i int, _local long, _rank long"
    )
    hit = covered.join(F.broadcast(ranks), "_i").where(
        (F.col("_local") >= F.col("_start")) & (F.col("_local") < F.col("_end"))
    )
    for r in hit.select("_i", "_rank", "_x").collect():
        found[intervals[r["_i"]][0]][r["_rank"]] = r["_x"]


def _narrow(spark, rows, names, key_fields, kind, intervals, found):
    shares = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    sketched = _inside(spark, rows, names, key_fields, kind, intervals)
    grids = {
        r["_i"]: r for r in sketched.groupBy("_i").agg(
            F.percentile_approx("_x", shares, F.lit(SKETCH_ACCURACY)).alias("cuts"),
            F.min("_x").alias("least"), F.max("_x").alias("most")).collect()
    }
    proposals = []
    for n, (key, low, high, size, ranks, halve) in enumerate(intervals):
        least, most, cuts = grids[n]["least"], grids[n]["most"], grids[n]["cuts"]
        for rank, local in ranks:
            cell = local * GRID // size
            # A cut outside the interval would reopen it.
            cut_low, cut_high = (min(max(c, least), most) for c in (cuts[max(cell - 1, 0)], cuts[min(cell + 2, GRID)]))
            if halve:
                # The sketch works on doubles; where it cannot separate the values, halve their range.
                cut_low = cut_high = least + (most - least) // 2 if isinstance(least, int) else least + (most - least) / 2
            proposals.append((key, low, high, size, [(rank, local)], cut_low, cut_high))
    counts = _count_cells(spark, rows, names, key_fields, kind, proposals)
    merged = {}
    for n, (key, low, high, size, [(rank, local)], cut_low, cut_high) in enumerate(proposals):
        below, at_low, middle, at_high = counts[n]
        if local < below:
            next_interval, start, inside = (low, cut_low), 0, below
        elif local < below + at_low:
            found[key][rank] = cut_low
            continue
        elif local < below + at_low + middle:
            next_interval, start, inside = (cut_low, cut_high), below + at_low, middle
        elif local < below + at_low + middle + at_high:
            found[key][rank] = cut_high
            continue
        else:
            start = below + at_low + middle + at_high
            next_interval, inside = (cut_high, high), size - start
        slot = merged.setdefault((key,) + next_interval, (inside, [], inside == size))
        slot[1].append((rank, local - start))
    return [(*interval, inside, ranks, stuck) for interval, (inside, ranks, stuck) in merged.items()]


def _count_cells(spark, rows, names, key_fields, kind, proposals):
    inside = _inside(spark, rows, names, key_fields, kind, proposals)
    cuts = spark.createDataFrame(
        [(n, p[5], p[6]) for n, p in enumerate(proposals)],
        T.StructType([T.StructField("_i", T.IntegerType()), T.StructField("_a", kind), T.StructField("_b", kind)]),
    )
    x, a, b = F.col("_x"), F.col("_a"), F.col("_b")
    counted = inside.join(F.broadcast(cuts), "_i").groupBy("_i").agg(
        F.count_if(x < a).alias("below"),
        F.count_if(x == a).alias("at_low"),
        F.count_if((x > a) & (x < b)).alias("middle"),
        F.count_if((x == b) & (a != b)).alias("at_high"),
    )
    return {r["_i"]: (r["below"], r["at_low"], r["middle"], r["at_high"]) for r in counted.collect()}


# ---------------------------------------------------------------- running totals

def running_totals(df: DataFrame, keys, order, measures, small_group=SMALL_GROUP, largest=None):
    """Add ``cum_<measure>``: inclusive running sums in ``order`` within ``keys``.

    ``df`` must hold one row per (keys, order), that is, be aggregated already. ``order`` is numeric.
    ``largest`` is the row count of the largest group if the caller knows it.
    """
    keys = list(keys)
    sizes = largest
    if sizes is None:
        sizes = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if sizes <= small_group:
        upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *[F.sum(m).over(upto).alias(f"cum_{m}") for m in measures])

    buckets = min(MAX_BUCKETS, 2 ** math.ceil(math.log2(4 * sizes / small_group)))
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    key_columns = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    cut_rows = df.groupBy(*key_columns).agg(
        F.percentile_approx(F.col(order).cast("double"), shares, F.lit(max(SKETCH_ACCURACY, 10 * buckets))).alias("_cuts"))
    # Collected once so that a recomputed stage meets the same cuts; keys x buckets numbers.
    cuts = df.sparkSession.createDataFrame(cut_rows.collect(), cut_rows.schema)
    matched = [df[k].eqNullSafe(cuts[f"_k{i}"]) for i, k in enumerate(keys)]
    bucketed = df.join(F.broadcast(cuts), matched, "inner").withColumn("_bucket", F.lit(0))
    step = buckets // 2
    while step:
        # Binary search: skip ``step`` cuts when the last of them lies left of the value.
        moves = F.element_at("_cuts", F.col("_bucket") + step) < F.col(order)
        bucketed = bucketed.withColumn("_bucket", F.col("_bucket") + F.when(moves, step).otherwise(0))
        step //= 2
    bucketed = bucketed.drop("_cuts", *[f"_k{i}" for i in range(len(keys))])

    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = bucketed.groupBy(*keys, "_bucket").agg(*[F.sum(m).alias(f"_sum_{m}") for m in measures])
    offsets = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"),
        *[F.coalesce(F.sum(f"_sum_{m}").over(before), F.lit(0)).alias(f"_before_{m}") for m in measures])
    upto = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = bucketed.select("*", *[F.sum(m).over(upto).alias(f"_local_{m}") for m in measures])
    same = [local[k].eqNullSafe(offsets[f"_k{i}"]) for i, k in enumerate(keys)]
    joined = local.join(F.broadcast(offsets), same + [local["_bucket"] == offsets["_b"]], "inner")
    return joined.select(
        *[df_column for df_column in df.columns],
        *[(F.col(f"_local_{m}") + F.col(f"_before_{m}")).alias(f"cum_{m}") for m in measures])
