"""Profiles of batches that are stored once and merged for any span of batches, so that history isn't read again.

A stored row describes one column of one batch: counts, mean, sum of squared deviations, extremes, a HyperLogLog sketch of the
distinct values and a KLL sketch of the distribution. Rows of a span are merged by one aggregation over stored rows, whose number
is batches times columns, whatever the batches held. Counts and extremes are exact, moments exact up to the last bits; the
other figures come with the bound of their error.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import PSI_EPSILON, is_numeric, psi_term, smooth
from .profile import CHUNK

#: Size of the distinct sketch: 2 to this power registers.
REGISTERS = 12
#: Size of the distribution sketch.
DISTRIBUTION = 400
#: Three standard errors of a merged distinct count, as a share of the count.
DISTINCT_ERROR = 3 * 1.04 / 2 ** (REGISTERS / 2)
#: Largest error of a rank (as a share of the rows) that a distribution sketch gives, at 99 % confidence for one rank.
RANK_ERROR = 2.296 / DISTRIBUTION ** 0.9021


def batch_profiles(df: DataFrame, batch, columns=None) -> DataFrame:
    """One row per batch (as text) and column, in one scan for every ``CHUNK`` columns; only sketches are shuffled.

    Values that are null or not a number are missing; columns that aren't numeric have no moments and no distribution. Zero and
    negative zero are one value. Rows without a batch are a batch of their own (null). An empty table gives no rows.
    """
    columns = [c for c in (columns or df.columns) if c != batch]
    parts = []
    for start in range(0, len(columns), CHUNK):
        aggregates, structs = [], []
        for i, name in enumerate(columns[start:start + CHUNK]):
            c, number = F.col(f"`{name}`"), is_numeric(df.schema[name].dataType)
            # Adding zero turns the negative zero into the other one.
            value = F.nanvl(c.cast("double") + 0.0, F.lit(None)) if number else F.lit(None).cast("double")
            # Floats go by their value, all else by its text, which keeps long integers apart.
            text = value.cast("string") if df.schema[name].dataType.typeName() in ("float", "double") else c.cast("string")
            measures = {
                "n_missing": F.count_if(text.isNull()), "mean": F.avg(value), "deviation": F.var_pop(value) * F.count(value),
                "low": F.min(value), "high": F.max(value), "distinct": F.hll_sketch_agg(text, REGISTERS),
                "distribution": F.kll_sketch_agg_double(value, DISTRIBUTION) if number else F.max(F.lit(None).cast("binary"))}
            aggregates += [a.alias(f"m{i}_{k}") for k, a in measures.items()]
            structs.append(F.struct(F.lit(name).alias("column_name"), F.lit(number).alias("numeric"), F.col("_rows").alias("n_rows"),
                                    *[F.col(f"m{i}_{k}").alias(k) for k in measures]))
        grouped = df.groupBy(F.col(f"`{batch}`").cast("string").alias("batch")).agg(F.count("*").alias("_rows"), *aggregates)
        parts.append(grouped.select("batch", F.inline(F.array(*structs))))
    return reduce(DataFrame.unionByName, parts)


def store_profiles(profiles: DataFrame, path):
    """Write profiles under ``path``, a folder per batch; a batch that is stored again takes the place of its old rows."""
    profiles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def stored_profiles(spark, path) -> DataFrame:
    """Stored profiles; conditions on ``batch`` (text) read the folders of those batches only."""
    names = "column_name string, numeric boolean, n_rows bigint, n_missing bigint, mean double, deviation double, low double, high double, distinct binary, distribution binary"
    return spark.read.schema(f"{names}, batch string").parquet(path)


def merge_profiles(profiles: DataFrame, by=()) -> DataFrame:
    """One row per column (and ``by``) for all batches in ``profiles``, in the form of a stored row, with ``n_batches``."""
    present = (F.col("n_rows") - F.col("n_missing")).cast("double")
    mean = F.when(F.col("n_present") > 0, F.col("_total") / F.col("n_present"))
    keyed = [*by, "column_name"]
    # The mean of the span first, so that deviations are taken from it rather than from differences of large squares.
    with_mean = profiles.withColumns({"n_present": F.sum(present).over(Window.partitionBy(*keyed)), "_total": F.sum(F.col("mean") * present).over(Window.partitionBy(*keyed))})
    shifted = with_mean.withColumn("_apart", F.col("deviation") + present * F.pow(F.col("mean") - mean, 2))
    return shifted.groupBy(*keyed).agg(
        F.bool_or("numeric").alias("numeric"), F.count("*").alias("n_batches"), F.sum("n_rows").alias("n_rows"), F.sum("n_missing").alias("n_missing"),
        F.max(mean).alias("mean"), F.sum("_apart").alias("deviation"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("distribution", DISTRIBUTION).alias("distribution"))


def span_figures(merged: DataFrame, probabilities=(0.25, 0.5, 0.75)) -> DataFrame:
    """Readable figures of merged rows: sample std, distinct values and quantiles with their bounds of error.

    A column without values has null moments and quantiles and 0 distinct values.
    """
    present = F.col("n_rows") - F.col("n_missing")
    quantiles = [F.when(F.col("numeric") & (present > 0), F.kll_sketch_get_quantile_double("distribution", F.lit(float(p)))).alias(f"q{round(p * 100)}")
                 for p in probabilities]
    return merged.select(
        *[c for c in merged.columns if c not in ("numeric", "deviation", "distinct", "distribution")],
        F.when(present > 1, F.sqrt(F.col("deviation") / (present - 1))).alias("std"),
        F.hll_sketch_estimate("distinct").alias("n_distinct"), F.lit(DISTINCT_ERROR).alias("distinct_error"),
        *quantiles, F.lit(RANK_ERROR).alias("rank_error"))


def span_psi(expected: DataFrame, actual: DataFrame, n_bins=10) -> DataFrame:
    """PSI per numeric column between two merged spans, on the quantiles of the first; no row of a batch is read.

    Each share is off by at most twice ``RANK_ERROR`` on either side. Columns without values on a side get 0.
    """
    present = (F.col("n_rows") > F.col("n_missing")) & F.col("numeric")
    wanted = F.array(*[F.lit(i / n_bins) for i in range(1, n_bins)])
    base = expected.where(present).select("column_name", F.col("distribution").alias("_e"))
    # A few numbers per column; ranks are asked for at literals only.
    cuts = {r[0]: sorted(set(r[1])) for r in base.select("column_name", F.kll_sketch_get_quantile_double("_e", wanted)).collect()}
    both = base.join(actual.where(present).select("column_name", F.col("distribution").alias("_a")), "column_name")
    everything = F.array(F.lit(1.0))

    def ranks_below(side):
        steps = None
        for name, at in cuts.items():
            ranks = F.kll_sketch_get_rank_double(side, F.array(*[F.lit(float(c)) for c in at]))
            own, below = F.col("column_name") == name, F.concat(ranks, everything)
            steps = F.when(own, below) if steps is None else steps.when(own, below)
        return F.lit(None).cast("array<double>") if steps is None else steps

    ranked = both.select("column_name", ranks_below("_e").alias("_e"), ranks_below("_a").alias("_a"))
    between = lambda c: F.zip_with(c, F.concat(F.array(F.lit(0.0)), F.slice(c, 1, F.size(c) - 1)), lambda r, before: r - before)
    binned = ranked.select("column_name", F.inline(F.arrays_zip(between("_e").alias("e"), between("_a").alias("a"))))
    found = binned.groupBy("column_name").agg(F.sum(psi_term(smooth("a", PSI_EPSILON), smooth("e", PSI_EPSILON))).alias("psi"))
    return expected.where("numeric").select("column_name").join(found, "column_name", "left").na.fill(0.0, ["psi"])
