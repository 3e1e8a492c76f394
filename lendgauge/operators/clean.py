"""Column selection, weights, imputing and category codes."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import numeric_columns
from .profile import per_column


def feature_list(df: DataFrame, exclude=(), label="label", oot_col=None, target="target", weight="weight"):
    """Column names that are not excluded, nor label, split tag, weight or time column."""
    hidden = set(exclude) | {label, target, weight} | ({oot_col} if oot_col else set())
    return [c for c in df.columns if c not in hidden]


def with_weight(df: DataFrame, weight="weight") -> DataFrame:
    return df if weight in df.columns else df.withColumn(weight, F.lit(1.0))


def impute(df: DataFrame, fill_value=-999.0, exclude=()) -> DataFrame:
    """Fill nulls of numeric columns with a constant."""
    columns = [c for c in numeric_columns(df) if c not in set(exclude)]
    return df.fillna(fill_value, subset=columns) if columns else df


def impute_report(df: DataFrame, exclude=()) -> DataFrame:
    """Missing cells per column before imputing, and whether imputing fills the column."""
    fillable = [c for c in numeric_columns(df) if c not in set(exclude)]
    counted = per_column(df, df.columns, lambda name: {
        "missing_before": (F.count_if(F.col(f"`{name}`").isNull()), "bigint")})
    return counted.withColumn("filled", F.col("column_name").isin(fillable) & (F.col("missing_before") > 0))


def drop_incomplete(df: DataFrame, columns) -> DataFrame:
    return df.dropna(subset=list(columns))


def category_codes(df: DataFrame, columns) -> DataFrame:
    """(column_name, value, code): dense codes from 0 per column, in the order of the value's MD5.

    The hash spreads any number of categories evenly over 256 buckets; ranks are taken inside the
    buckets and shifted by the sizes of the buckets before.
    """
    parts = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    values = df.select(F.explode(F.array(*parts)).alias("v")).select("v.*").where(F.col("value").isNotNull())
    values = values.distinct().withColumn("_h", F.md5(F.col("value").cast("binary")))
    values = values.withColumn("_b", F.substring("_h", 1, 2))
    inside = Window.partitionBy("column_name", "_b").orderBy("_h", "value")
    before = Window.partitionBy("column_name").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = values.groupBy("column_name", "_b").agg(F.count("*").alias("_n")).select(
        "column_name", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ranked = values.withColumn("_r", F.row_number().over(inside))
    return ranked.join(F.broadcast(offsets), ["column_name", "_b"]).select(
        "column_name", "value", (F.col("_r") - 1 + F.col("_offset")).cast("double").alias("code"))


def encode_categories(df: DataFrame, codes: DataFrame, columns) -> DataFrame:
    """Replace text columns by their codes; null and values without a code become null.

    Codes are fitted once and reused. The joins carry no hint: Spark broadcasts a small code table
    and shuffles a large one, splitting a hot category with its skew handling.
    """
    def encode(frame, c):
        table = codes.where(F.col("column_name") == c).select(
            F.col("value").alias("_value"), F.col("code").alias("_code"))
        joined = frame.join(table, F.col(f"`{c}`").cast("string") == F.col("_value"), "left")
        return joined.withColumn(c, F.col("_code")).drop("_value", "_code")

    return reduce(encode, columns, df).select(*df.columns)
