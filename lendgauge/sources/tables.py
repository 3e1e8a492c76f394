"""Reading application tables and writing snapshots, reports and logs."""

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark, path, schema=None) -> DataFrame:
    """Parquet by its suffix (a folder or file ending in ``.parquet``), anything else as CSV.

    NaN becomes null once, here, so that null is the only missing value afterwards. Give ``schema``
    for large CSV input: inferring types reads the file twice.
    """
    if str(path).rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floating:
        return df
    return df.withColumns({c: F.when(F.isnan(F.col(f"`{c}`")), None).otherwise(F.col(f"`{c}`")) for c in floating})


def table_shape(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, and the row and column counts of the table."""
    kinds = [F.struct(F.lit(i).alias("position"), F.lit(name).alias("column_name"), F.lit(kind).alias("data_type"))
             for i, (name, kind) in enumerate(df.dtypes)]
    counted = df.agg(F.count("*").alias("n_rows"))
    return counted.select(F.inline(F.array(*kinds)), "n_rows", F.lit(len(df.columns)).alias("n_cols"))


def preview(df: DataFrame, rows=100) -> DataFrame:
    """The first rows as JSON records with ISO timestamps; nulls are written out."""
    shown = df.limit(rows)
    return shown.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def write_snapshot(df: DataFrame, source_path, stamp=None) -> str:
    """Write next to the source as ``{base}_imputed_{stamp}`` in the same format; never overwrites."""
    path = str(source_path).rstrip("/")
    base, dot, suffix = path.rpartition(".")
    if not dot or "/" in suffix:
        base, suffix = path, "csv"
    target = f"{base}_imputed_{stamp or int(time.time())}.{suffix}"
    writer = df.write.mode("errorifexists")
    if suffix == "parquet":
        writer.parquet(target)
    else:
        writer.option("header", True).csv(target)
    return target


def write_csv_detail(detail: DataFrame, path) -> str:
    """Write a bin-sized table as one CSV part."""
    if not isinstance(path, str) or not path.endswith(".csv"):
        raise ValueError(f"the path must end in .csv: {path!r}")
    detail.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_sections(sections, folder) -> dict:
    """One Parquet folder per report section."""
    paths = {}
    for name, section in sections.items():
        paths[name] = f"{folder}/{name}"
        section.write.mode("overwrite").parquet(paths[name])
    return paths


def append_log(entry: DataFrame, path, batch_name=None) -> DataFrame:
    """Append one batch summary to a log table; ``created_at`` is set when absent."""
    if batch_name is not None:
        entry = entry.withColumn("batch_name", F.lit(batch_name))
    if "created_at" not in entry.columns:
        entry = entry.withColumn("created_at", F.current_timestamp())
    entry.write.mode("append").parquet(path)
    return entry
