"""Column profiles: every statistic of every column comes from one fused aggregation."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guards import is_numeric, numeric_columns, ratio
from .ranks import SMALL_GROUP, quantiles

# Columns per aggregation; wider tables take several column-pruned scans.
CHUNK = 100

# The published quantile grid.
QUANTILE_GRID = [0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]

# Screening ignores these columns (lower case) beside the label.
SYSTEM_COLUMNS = {"target", "weight", "id", "uuid"}

# Name parts that mark a column as an identifier or a time.
ID_WORDS = {"id", "no", "num", "number", "key", "code", "uuid", "seq", "sn", "pk", "fk"}
TIME_WORDS = {"date", "time", "dt", "day", "month", "year", "ts", "timestamp", "period"}


def per_column(df: DataFrame, columns, measures) -> DataFrame:
    """One row per column from one wide aggregation.

    ``measures(name)`` gives ``{output: (aggregate Column, type)}``; all columns share the outputs.
    """
    columns = list(columns)
    parts = []
    for start in range(0, len(columns), CHUNK):
        chunk = columns[start:start + CHUNK]
        wanted = {name: measures(name) for name in chunk}
        aggregates = [
            column.cast(kind).alias(f"m{start + i}_{output}")
            for i, name in enumerate(chunk) for output, (column, kind) in wanted[name].items()
        ]
        structs = [
            F.struct(F.lit(name).alias("column_name"),
                     *[F.col(f"m{start + i}_{output}").alias(output) for output in wanted[name]])
            for i, name in enumerate(chunk)
        ]
        parts.append(df.agg(*aggregates).select(F.inline(F.array(*structs))))
    return reduce(DataFrame.unionByName, parts)


def _missing(df, name, impute_value):
    c = F.col(f"`{name}`")
    absent = c.isNull()
    if impute_value is not None and is_numeric(df.schema[name].dataType):
        absent = absent | (c == F.lit(impute_value))
    return absent


def missing_profile(df: DataFrame, columns=None, impute_value=None) -> DataFrame:
    """Missing count and rate; in numeric columns the impute value is missing too."""
    columns = columns or df.columns
    counted = per_column(df, columns, lambda name: {
        "n_missing": (F.count_if(_missing(df, name, impute_value)), "bigint"),
        "n_rows": (F.count("*"), "bigint"),
    })
    return counted.select("column_name", "n_missing", ratio("n_missing", "n_rows").alias("missing_rate"))


def quantile_frame(df: DataFrame, columns, probabilities, names, by=(), small_group=SMALL_GROUP) -> DataFrame:
    """Exact quantiles as a table with one row per column (and group)."""
    by = list(by)
    values = quantiles(df, columns, probabilities, by, small_group)
    empty = [None] * len(probabilities)
    rows = [tuple(group) + (c,) + tuple(found or empty)
            for group, per in values.items() for c, found in per.items()]
    schema = T.StructType([df.schema[k] for k in by] + [T.StructField("column_name", T.StringType())]
                          + [T.StructField(n, T.DoubleType()) for n in names])
    return df.sparkSession.createDataFrame(rows, schema)


def describe_numeric(df: DataFrame, columns=None) -> DataFrame:
    """count, mean, sample std, min, quartiles and max of numeric columns."""
    columns = columns or numeric_columns(df)

    def measures(name):
        c = F.col(f"`{name}`")
        return {"count": (F.count(c), "bigint"), "mean": (F.avg(c), "double"), "std": (F.stddev_samp(c), "double"),
                "min": (F.min(c), "double"), "max": (F.max(c), "double")}

    quartiles = quantile_frame(df, columns, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    stats = per_column(df, columns, measures)
    return stats.join(F.broadcast(quartiles), "column_name").select(
        "column_name", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def quantile_grid(df: DataFrame, columns=None) -> DataFrame:
    columns = columns or numeric_columns(df)
    return quantile_frame(df, columns, QUANTILE_GRID, [f"q{round(p * 100)}" for p in QUANTILE_GRID])


def label_distribution(df: DataFrame, label="label") -> DataFrame:
    """Rows per label value; rows without a label are not listed."""
    return df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def std_profile(df: DataFrame, columns=None) -> DataFrame:
    """Sample standard deviation; zero for columns that are not numeric."""
    columns = columns or df.columns

    def measures(name):
        if is_numeric(df.schema[name].dataType):
            return {"std": (F.stddev_samp(F.col(f"`{name}`")), "double")}
        return {"std": (F.max(F.lit(0.0)), "double")}

    return per_column(df, columns, measures)


def value_counts(df: DataFrame, columns=None) -> DataFrame:
    """(column_name, number, text, n) per distinct value: floats as numbers, the rest by 128 bits of their text.

    Partial counts are merged before the shuffle, so a value that fills a column costs one row per
    task, and long texts aren't sent. Text keeps long integers exact.
    """
    columns = columns or df.columns
    parts = []
    for name in columns:
        c, floating = F.col(f"`{name}`"), isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))
        parts.append(F.struct(
            F.lit(name).alias("column_name"),
            (c.cast("double") if floating else F.lit(None).cast("double")).alias("number"),
            (F.lit(None).cast("binary") if floating else F.unhex(F.md5(c.cast("string")))).alias("text")))
    long = df.select(F.explode(F.array(*parts)).alias("v")).select("v.*")
    return long.groupBy("column_name", "number", "text").agg(F.count("*").alias("n"))


def distinct_profile(df: DataFrame, columns=None, approximate=False) -> DataFrame:
    """Distinct values per column, nulls not counted, and the share of the most frequent value.

    ``approximate`` gives the count from a sketch in one scan without the shuffle of values.
    """
    columns = columns or df.columns
    if approximate:
        return per_column(df, columns, lambda name: {
            "n_distinct": (F.approx_count_distinct(F.col(f"`{name}`")), "bigint")})
    present = F.col("number").isNotNull() | F.col("text").isNotNull()
    counted = value_counts(df, columns).groupBy("column_name").agg(
        F.count_if(present).alias("n_distinct"),
        F.max(F.when(present, F.col("n"))).alias("top_count"),
        F.sum(F.when(present, F.col("n"))).alias("n_present"))
    return counted.select(
        "column_name", "n_distinct", ratio("top_count", "n_present").alias("top_share"))


def top_share(df: DataFrame, columns=None) -> DataFrame:
    """Share of the most frequent value among values that are present; 0 for an empty column."""
    names = columns or df.columns
    listed = df.sparkSession.createDataFrame([(n,) for n in names], "column_name string")
    shares = distinct_profile(df, names).select("column_name", "top_share")
    return listed.join(shares, "column_name", "left").select(
        "column_name", F.coalesce("top_share", F.lit(0.0)).alias("top_share"))


def dataset_summary(df: DataFrame, label="label", freq_limit=0.95, missing_limit=0.95, impute_value=None) -> DataFrame:
    """All profiles side by side plus the screening verdict of every non-system column."""
    from .screen import screen_basic

    system = SYSTEM_COLUMNS | {label.lower()}
    features = [c for c in df.columns if c.lower() not in system]
    places = {n: (i, k) for i, (n, k) in enumerate(df.dtypes)}
    screened = screen_basic(df, features, freq_limit, missing_limit, impute_value).select(
        "column_name", "kept", "reason")
    numeric = numeric_columns(df)

    def measures(name):
        c, number = F.col(f"`{name}`"), name in numeric
        nothing = F.lit(None)
        # Constants stay outside the aggregates: a text among those would keep them all from generated code.
        fixed = [F.when(F.count("*") > 0, F.lit(place)) for place in places[name]]
        return {
            "position": (fixed[0], "int"), "data_type": (fixed[1], "string"),
            "n_missing": (F.count_if(_missing(df, name, impute_value)), "bigint"), "n_rows": (F.count("*"), "bigint"),
            "count": (F.count(c) if number else nothing, "bigint"), "mean": (F.avg(c) if number else nothing, "double"),
            "std": (F.stddev_samp(c) if number else nothing, "double"), "min": (F.min(c) if number else nothing, "double"),
            "max": (F.max(c) if number else nothing, "double")}

    shares = sorted({0.25, 0.75, *QUANTILE_GRID})
    names = [f"q{round(p * 100)}" for p in shares]
    grid = quantile_frame(df, numeric, shares, names)
    stats = per_column(df, df.columns, measures).join(F.broadcast(grid), "column_name", "left")
    return stats.join(F.broadcast(screened), "column_name", "left").select(
        "position", "column_name", "data_type", "n_missing", ratio("n_missing", "n_rows").alias("missing_rate"), "count",
        "mean", "std", "min", *names, "max", "kept", "reason").orderBy("position")


def overview(df: DataFrame) -> DataFrame:
    """One row: shape, columns per type, averages over numeric columns, overall missing rate."""
    numeric = numeric_columns(df)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]

    def measures(name):
        c = F.col(f"`{name}`")
        number = name in numeric
        return {"missing_rate": (F.avg(F.when(c.isNull(), 1.0).otherwise(0.0)), "double"),
                "mean": (F.avg(c) if number else F.max(F.lit(None)), "double"),
                "std": (F.stddev_samp(c) if number else F.max(F.lit(None)), "double"),
                "min": (F.min(c) if number else F.max(F.lit(None)), "double"),
                "max": (F.max(c) if number else F.max(F.lit(None)), "double"),
                "n_rows": (F.count("*"), "bigint")}

    stats = per_column(df, df.columns, measures)
    return stats.agg(
        F.max("n_rows").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_cols"),
        F.lit(len(numeric)).alias("n_numeric"),
        F.lit(len(texts)).alias("n_text"),
        F.lit(len(times)).alias("n_time"),
        F.avg("mean").alias("mean_of_means"),
        F.avg("std").alias("mean_of_stds"),
        F.min("min").alias("overall_min"),
        F.max("max").alias("overall_max"),
        F.count_if(F.col("missing_rate") > 0).alias("n_missing_cols"),
        F.avg("missing_rate").alias("overall_missing_rate"),
    )


def top_missing(df: DataFrame, n=8) -> DataFrame:
    """The columns with most missing values (top-k report)."""
    return missing_profile(df).where(F.col("missing_rate") > 0).select(
        "column_name", F.round("missing_rate", 4).alias("missing_rate")
    ).orderBy(F.desc("missing_rate"), "column_name").limit(n)


def suspect_columns(df: DataFrame) -> DataFrame:
    """Columns that look like identifiers or times, by name part or by too many distinct texts."""
    verdicts, open_texts = [], []
    for name, kind in df.dtypes:
        parts = set(name.lower().replace("_", " ").replace("-", " ").split()) | {name.lower()}
        if parts & ID_WORDS:
            verdicts.append((name, kind, "identifier name"))
        elif parts & TIME_WORDS:
            verdicts.append((name, kind, "time name"))
        elif kind == "string":
            open_texts.append(name)
    schema = "column_name string, data_type string, reason string"
    named = df.sparkSession.createDataFrame(verdicts, schema)
    if not open_texts:
        return named
    limit = max(df.count() * 0.5, 100)
    many = distinct_profile(df, open_texts).where(F.col("n_distinct") > limit)
    return named.unionByName(many.select(
        "column_name", F.lit("string").alias("data_type"), F.lit("many distinct texts").alias("reason")))
