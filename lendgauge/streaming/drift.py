"""Score drift of a stream: windowed bin counts against a fixed baseline.

The state is one counter per open window and bin. Two kinds of output: the newest counts of all windows, open ones too, in one
table that each micro-batch merges into; and windows that are closed (the watermark has passed them), each written once.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import INF, bin_number
from ..functions.guards import PSI_EPSILON, psi_term, smooth
from ..operators.psi import stability_band
from ..session import deleted, finished


def windowed_counts(stream: DataFrame, time_col, score, edges, window="30 days", late="7 days") -> DataFrame:
    """(window_start, bin, n) of a stream or table; rows later than ``late`` are not counted by a stream."""
    opened = [-INF, *edges[1:-1], INF]
    timed = stream.select(F.col(time_col).cast("timestamp").alias("_time"), F.col(score).alias("_score"))
    binned = timed.withColumn("bin", bin_number(F.col("_score"), opened, "left_highest")).where(F.col("bin").isNotNull())
    return binned.withWatermark("_time", late).groupBy(F.window("_time", window).alias("w"), "bin").agg(
        F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "bin", "n")


def merge_counts(batch: DataFrame, number, folder):
    """Merge the changed counts of micro-batch ``number`` into the table under ``folder``.

    The table has a generation per micro-batch, made from the one before; only the last two are there. A repeated batch makes its
    generation anew, so nothing is counted twice.
    """
    spark = batch.sparkSession
    before = [n for n in generations(spark, folder) if n < number]
    table = batch
    if before:
        held = spark.read.schema(batch.schema).parquet(f"{folder}/counts-{before[-1]}")
        table = held.join(batch, ["window_start", "bin"], "left_anti").unionByName(batch)
    table.write.mode("overwrite").parquet(f"{folder}/counts-{number}")
    for old in before[:-1]:
        deleted(spark, f"{folder}/counts-{old}")


def generations(spark, folder):
    """Numbers of the generations that were written to an end, in order."""
    return sorted(int(name.split("-")[1]) for name in finished(spark, folder) if name.startswith("counts-"))


def start_counting(counts: DataFrame, folder, checkpoint, **trigger):
    """Start the stream that keeps the newest counts of all windows under ``folder``."""
    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, number: merge_counts(batch, number, folder)).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def newest_counts(spark, folder) -> DataFrame:
    """The last written count of every window and bin."""
    return spark.read.parquet(f"{folder}/counts-{generations(spark, folder)[-1]}")


def start_closing(counts: DataFrame, folder, checkpoint, **trigger):
    """Start the stream that writes the counts of each window to ``folder`` once, when the watermark has passed its end."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", folder).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def band_changes(shifts: DataFrame) -> DataFrame:
    """``shifts`` (a row per window) with the stability band, that of the window before (null at first) and whether they differ."""
    timed = Window.partitionBy(F.lit(1)).orderBy("window_start")
    banded = shifts.withColumn("band", stability_band("psi")).withColumn("band_before", F.lag("band").over(timed))
    return banded.withColumn("changed", F.coalesce(F.col("band") != F.col("band_before"), F.lit(False)))


def window_psi(counts: DataFrame, baseline) -> DataFrame:
    """(window_start, psi, n): every window against ``baseline``, the rows per bin in order."""
    spark = counts.sparkSession
    base = F.broadcast(spark.createDataFrame(
        [(i, float(n)) for i, n in enumerate(baseline, 1)], "bin int, expected double"))
    dense = counts.select("window_start").distinct().select(
        "window_start", F.explode(F.array(*[F.lit(i) for i in range(1, len(baseline) + 1)])).alias("bin"))
    filled = dense.join(base, "bin").join(counts, ["window_start", "bin"], "left").na.fill(0, ["n"])
    group = Window.partitionBy("window_start")
    shares = filled.withColumns({
        "_a": smooth(F.try_divide("n", F.sum("n").over(group)), PSI_EPSILON),
        "_e": smooth(F.try_divide("expected", F.sum("expected").over(group)), PSI_EPSILON)})
    return shares.groupBy("window_start").agg(F.sum(psi_term("_a", "_e")).alias("psi"), F.sum("n").alias("n"))
