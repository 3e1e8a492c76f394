"""Queries over whole tables: reading, profiles, cleaning and splits."""

from pyspark.sql import functions as F

from ...functions.guards import clip, finite, finite_or_zero, numeric, ratio, smooth
from ...functions.periods import month_of, parse_time
from ...operators import clean, profile, split
from ...sources.tables import preview, read_table, table_shape
from ..loanbook import NUMERIC_FEATURES, applications, kept_applications
from .registry import long_part, on_app, query, r6, rounded

FEATURES = NUMERIC_FEATURES
LISTED = ", ".join(FEATURES)


# ---------------------------------------------------------------- sources

@query("read_orders", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
       o_orderpriority FROM orders""")
def read_orders(spark, folder):
    return read_table(spark, f"{folder}/orders.parquet").withColumn(
        "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


LINEITEM_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string",
    "l_shipdate": "timestamp_ntz"}


@query("table_shape_lineitem", " UNION ALL ".join(
    f"SELECT CAST({i} AS INT) AS position, '{c}' AS column_name, '{kind}' AS data_type, COUNT(*) AS n_rows, CAST({len(LINEITEM_TYPES)} AS INT) AS n_cols FROM lineitem"
    for i, (c, kind) in enumerate(LINEITEM_TYPES.items())))
def table_shape_lineitem(spark, folder):
    return table_shape(read_table(spark, f"{folder}/lineitem.parquet"))


@query("preview_nation", "SELECT CAST(to_json(n) AS VARCHAR) AS record FROM nation n")
def preview_nation(spark, folder):
    return preview(read_table(spark, f"{folder}/nation.parquet"))


# ---------------------------------------------------------------- profiles

PROFILED = ["app_id", "apply_month", "segment", "priority", *FEATURES, "label"]


@query("missing_profile", on_app(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) FILTER ({c} IS NULL{hit}) AS n_missing, "
        f"round(COUNT(*) FILTER ({c} IS NULL{hit}) / COUNT(*), 6) AS missing_rate FROM imp"
        for c, hit in [("segment", ""), *[(f, f" OR {f} = -999") for f in FEATURES]]),
    "imp AS (SELECT segment, amount, balance, COALESCE(n_items, -999) AS n_items, COALESCE(qty, -999) AS qty, "
    "avg_disc, max_tax, n_ret FROM app)"))
def missing_profile(spark, folder):
    app = applications(spark, folder, ["segment", *FEATURES]).fillna(-999.0, ["n_items", "qty"])
    return rounded(profile.missing_profile(app, impute_value=-999.0))


@query("describe_lineitem", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"round(CAST(min({c}) AS DOUBLE), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, "
    f"round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, "
    f"round(CAST(max({c}) AS DOUBLE), 6) AS max FROM lineitem"
    for c in ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def describe_lineitem(spark, folder):
    return rounded(profile.describe_numeric(
        read_table(spark, f"{folder}/lineitem.parquet"),
        ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query("quantile_grid", on_app(
    "SELECT feature AS column_name, " + ", ".join(
        f"round(quantile_cont(value, {p}), 6) AS q{round(p * 100)}" for p in profile.QUANTILE_GRID)
    + " FROM long GROUP BY feature", long_part()))
def quantile_grid(spark, folder):
    return rounded(profile.quantile_grid(kept_applications(spark, folder, FEATURES)))


@query("label_distribution", on_app("SELECT label, COUNT(*) AS n FROM app GROUP BY label"))
def label_distribution(spark, folder):
    return profile.label_distribution(applications(spark, folder, ["label"]))


@query("std_profile", on_app(" UNION ALL ".join(
    [f"SELECT '{f}' AS column_name, round(stddev_samp({f}), 6) AS std FROM app" for f in FEATURES]
    + ["SELECT 'segment', 0.0"])))
def std_profile(spark, folder):
    return rounded(profile.std_profile(applications(spark, folder, [*FEATURES, "segment"])))


@query("top_share", on_app(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(max(n) / sum(n), 6) AS top_share FROM "
    f"(SELECT {c}, COUNT(*) AS n FROM app WHERE {c} IS NOT NULL GROUP BY {c})" for c in PROFILED)))
def top_share(spark, folder):
    return rounded(profile.top_share(applications(spark, folder, PROFILED)))


@query("distinct_profile", on_app(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) AS n_distinct, round(max(n) / SUM(n), 6) AS top_share FROM "
    f"(SELECT COUNT(*) AS n FROM app WHERE {c} IS NOT NULL GROUP BY {c})" for c in PROFILED)))
def distinct_profile(spark, folder):
    return rounded(profile.distinct_profile(applications(spark, folder, PROFILED)))


@query("dataset_summary", on_app(" UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, COUNT(*) FILTER ({c} IS NULL) AS n_missing, "
    f"round(COUNT(*) FILTER ({c} IS NULL) / COUNT(*), 6) AS missing_rate, "
    + (f"COUNT({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
       f"round(quantile_cont({c}, 0.01), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS q50, "
       f"round(quantile_cont({c}, 0.99), 6) AS q99, "
       if c not in ("segment", "mostly_a") else
       "CAST(NULL AS BIGINT) AS count, NULL AS mean, NULL AS std, NULL AS q1, NULL AS q50, NULL AS q99, ")
    + {"label": "CAST(NULL AS BOOLEAN) AS kept, CAST(NULL AS VARCHAR) AS reason",
       "mostly_a": "false AS kept, 'freq' AS reason", "always": "false AS kept, 'freq' AS reason"}.get(
           c, "true AS kept, NULL AS reason") + " FROM ext"
    for i, c in enumerate([*FEATURES, "segment", "label", "mostly_a", "always"])),
    "ext AS (SELECT *, CASE WHEN app_id % 50 = 0 THEN 'b' ELSE 'a' END AS mostly_a, 1.0::DOUBLE AS always FROM app)"))
def dataset_summary(spark, folder):
    app = kept_applications(spark, folder, [*FEATURES, "segment", "label", "app_id"]).withColumns({
        "mostly_a": F.when(F.col("app_id") % 50 == 0, "b").otherwise("a"), "always": F.lit(1.0)}).drop("app_id")
    return rounded(profile.dataset_summary(app).select(
        "position", "column_name", "n_missing", "missing_rate", "count", "mean", "std", "q1", "q50", "q99", "kept", "reason"))


@query("overview", on_app(
    "SELECT any_value(n_rows) AS n_rows, 9 AS n_cols, 8 AS n_numeric, 1 AS n_text, 0 AS n_time, "
    + r6(("avg(mean)", "mean_of_means"), ("avg(std)", "mean_of_stds"), ("min(low)", "overall_min"),
         ("max(high)", "overall_max"))
    + ", COUNT(*) FILTER (miss > 0) AS n_missing_cols, round(avg(miss), 6) AS overall_missing_rate FROM s",
    "s AS (" + " UNION ALL ".join(
        [f"SELECT COUNT(*) AS n_rows, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS low, max({c}) AS high, "
         f"COUNT(*) FILTER ({c} IS NULL) / COUNT(*) AS miss FROM app" for c in [*FEATURES, "label"]]
        + ["SELECT COUNT(*), NULL, NULL, NULL, NULL, COUNT(*) FILTER (segment IS NULL) / COUNT(*) FROM app"]) + ")"))
def overview(spark, folder):
    return rounded(profile.overview(applications(spark, folder, [*FEATURES, "label", "segment"])))


@query("top_missing", on_app(
    "SELECT feature AS column_name, round(COUNT(*) FILTER (value IS NULL) / COUNT(*), 4) AS missing_rate "
    "FROM long GROUP BY feature HAVING COUNT(*) FILTER (value IS NULL) > 0 ORDER BY 2 DESC, 1 LIMIT 8", long_part()))
def top_missing(spark, folder):
    return profile.top_missing(applications(spark, folder, FEATURES))


@query("suspect_columns", """
SELECT 'doc_id' AS column_name, 'bigint' AS data_type, 'identifier name' AS reason UNION ALL
SELECT 'text', 'string', 'many distinct texts' FROM documents HAVING COUNT(DISTINCT text) > greatest(COUNT(*) * 0.5, 100)
UNION ALL SELECT 'lang', 'string', 'many distinct texts' FROM documents HAVING COUNT(DISTINCT lang) > greatest(COUNT(*) * 0.5, 100)
UNION ALL SELECT 'source', 'string', 'many distinct texts' FROM documents
  HAVING COUNT(DISTINCT source) > greatest(COUNT(*) * 0.5, 100)""")
def suspect_columns(spark, folder):
    return profile.suspect_columns(spark.read.parquet(f"{folder}/documents.parquet"))


# ---------------------------------------------------------------- cleaning and expressions

@query("feature_list", on_app("SELECT app_id, " + LISTED + " FROM app"))
def feature_list(spark, folder):
    app = applications(spark, folder, ["app_id", "apply_time", *FEATURES, "label", "target", "weight"])
    return app.select(*clean.feature_list(app, oot_col="apply_time"))


@query("default_weight", "SELECT o_orderkey, 1.0::DOUBLE AS weight FROM orders")
def default_weight(spark, folder):
    return clean.with_weight(spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey"))


@query("impute_values", on_app(
    "SELECT app_id, amount, balance, " + ", ".join(f"COALESCE({c}, -999) AS {c}" for c in ("n_items", "qty", "avg_disc", "max_tax"))
    + ", n_ret FROM app"))
def impute_values(spark, folder):
    return clean.impute(applications(spark, folder, ["app_id", *FEATURES]), -999.0, ["n_ret"])


@query("impute_report", on_app(
    "SELECT feature AS column_name, COUNT(*) FILTER (value IS NULL) AS missing_before, "
    "feature <> 'n_ret' AND COUNT(*) FILTER (value IS NULL) > 0 AS filled FROM long GROUP BY feature", long_part()))
def impute_report(spark, folder):
    return clean.impute_report(applications(spark, folder, FEATURES), ["n_ret"])


@query("category_codes", on_app(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS value, CAST(dense_rank() OVER (ORDER BY md5({c}), {c}) - 1 AS DOUBLE) AS code "
        f"FROM (SELECT DISTINCT {c} FROM app)" for c in ("segment", "priority"))))
def category_codes(spark, folder):
    return clean.category_codes(applications(spark, folder, ["segment", "priority"]), ["segment", "priority"])


@query("encode_categories", on_app(
    "SELECT app_id, CAST(dense_rank() OVER (ORDER BY md5(segment), segment) - 1 AS DOUBLE) AS segment FROM app"))
def encode_categories(spark, folder):
    app = applications(spark, folder, ["app_id", "segment"])
    return clean.encode_categories(app, clean.category_codes(app, ["segment"]), ["segment"])


TIME_SQL = """
SELECT app_id, strftime(date_trunc('month', apply_time), '%Y-%m-%d') AS from_month,
  strftime(date_trunc('month', apply_time), '%Y-%m-%d') AS from_day, strftime(apply_time, '%Y-%m-%d') AS from_seconds,
  CASE WHEN app_id = 0 THEN NULL ELSE strftime(apply_time, '%Y-%m-%d') END AS from_text,
  strftime(apply_time, '%Y-%m-%d') AS from_timestamp FROM app"""


@query("parse_times", on_app(TIME_SQL))
def parse_times(spark, folder):
    app = applications(spark, folder, ["app_id", "apply_time", "apply_month"])
    shaped = app.select(
        "app_id", F.col("apply_month").alias("from_month"), (F.col("apply_month") * 100 + 1).alias("from_day"),
        F.unix_timestamp(F.col("apply_time").cast("timestamp")).alias("from_seconds"),
        F.when(F.col("app_id") == 0, "not a time").otherwise(F.date_format("apply_time", "yyyy-MM-dd'T'HH:mm:ss")).alias("from_text"),
        F.col("apply_time").alias("from_timestamp"))
    return shaped.select("app_id", *[
        F.date_format(parse_time(shaped, c), "yyyy-MM-dd").alias(c) for c in shaped.columns[1:]])


@query("month_periods", on_app("SELECT month_time, COUNT(*) AS n FROM app GROUP BY month_time"))
def month_periods(spark, folder):
    app = applications(spark, folder, ["apply_time"])
    return app.groupBy(month_of(parse_time(app, "apply_time")).alias("month_time")).agg(F.count("*").alias("n"))


@query("drop_incomplete", on_app("SELECT app_id, n_items, qty FROM app WHERE n_items IS NOT NULL AND qty IS NOT NULL"))
def drop_incomplete(spark, folder):
    return clean.drop_incomplete(applications(spark, folder, ["app_id", "n_items", "qty"]), ["n_items", "qty"])


@query("guarded_expressions", on_app("""
SELECT app_id, CASE WHEN balance = 0 THEN NULL ELSE round(amount / balance, 4) END AS finite_ratio,
  CASE WHEN n_ret > 0 THEN round(amount / n_ret, 4) ELSE 0 END AS guarded, round(least(greatest(proba, 0.1), 0.8), 6) AS clipped,
  CASE WHEN n_ret = 0 THEN 1e-4 ELSE n_ret END AS smoothed, TRY_CAST(mixed AS DOUBLE) AS number,
  COALESCE(CASE WHEN n_ret = 0 THEN NULL ELSE round(qty / n_ret, 2) END, 0) AS or_zero
FROM (SELECT *, CASE WHEN label = 1 THEN 'n/a' ELSE CAST(CAST(weight AS INT) AS VARCHAR) END AS mixed FROM app)"""))
def guarded_expressions(spark, folder):
    app = applications(spark, folder, ["app_id", "amount", "balance", "qty", "n_ret", "proba", "label", "weight"])
    mixed = F.when(F.col("label") == 1, "n/a").otherwise(F.col("weight").cast("int").cast("string"))
    infinite = F.when(F.col("n_ret") == 0, F.lit(float("inf"))).otherwise(F.try_divide("qty", "n_ret"))
    return app.withColumn("mixed", mixed).select(
        "app_id", F.round(finite(F.when(F.col("balance") == 0, F.lit(float("nan"))).otherwise(
            F.try_divide("amount", "balance"))), 4).alias("finite_ratio"),
        F.round(ratio("amount", "n_ret"), 4).alias("guarded"), F.round(clip("proba", 0.1, 0.8), 6).alias("clipped"),
        smooth("n_ret", 1e-4).alias("smoothed"), numeric("mixed").alias("number"),
        F.round(finite_or_zero(infinite), 2).alias("or_zero"))


# ---------------------------------------------------------------- splits

def timed_oot(share):
    return (f"SELECT app_id, CASE WHEN row_number() OVER (ORDER BY apply_time, app_id) - 1 >= "
            f"CAST(floor(COUNT(*) OVER () * (1 - {share}::DOUBLE)) AS BIGINT) THEN 'oot' END AS split FROM app")


@query("split_time_share", on_app(timed_oot(0.15)))
def split_time_share(spark, folder):
    app = kept_applications(spark, folder, ["app_id", "apply_time"])
    return split.tag_oot_by_share(app, "apply_time", "app_id", 0.15).select("app_id", "split")


@query("split_time_default_share", on_app(timed_oot(0.2).replace("apply_time", "apply_month")))
def split_time_default_share(spark, folder):
    app = kept_applications(spark, folder, ["app_id", "apply_month"])
    share = split.default_oot_share([0.6, 0.2, 0.2])
    return split.tag_oot_by_share(app, "apply_month", "app_id", share).select("app_id", "split")


@query("split_time_start", on_app(
    "SELECT app_id, CASE WHEN apply_time >= TIMESTAMP '2000-04-01' THEN 'oot' END AS split FROM app"))
def split_time_start(spark, folder):
    app = applications(spark, folder, ["app_id", "apply_time"])
    return split.tag_oot_by_time(app, "apply_time", "2000-04-01").select("app_id", "split")


@query("split_preset", on_app(
    "SELECT app_id, CASE WHEN apply_time >= TIMESTAMP '2000-01-01' THEN 'oot' WHEN target <> 'oot' THEN target END AS split "
    "FROM app"))
def split_preset(spark, folder):
    app = kept_applications(spark, folder, ["app_id", "apply_time", "target"]).withColumn("target", F.upper("target"))
    return split.split_dataset(app, "app_id", oot_col="apply_time", oot_start="2000-01-01").select("app_id", "split")


def drawn(where="true"):
    return (f"drawn AS (SELECT app_id, label, row_number() OVER (PARTITION BY label ORDER BY "
            f"CAST('0x' || substr(md5(app_id || ':42'), 1, 13) AS BIGINT)) - 1 AS rank, COUNT(*) OVER (PARTITION BY label) AS n "
            f"FROM app WHERE {where})")


@query("split_stratified_two", on_app(
    "SELECT app_id, CASE WHEN rank < floor(n * (0.7::DOUBLE / (0.7::DOUBLE + 0.3::DOUBLE))) THEN 'train' ELSE 'valid' END AS split "
    "FROM drawn", drawn()))
def split_stratified_two(spark, folder):
    app = kept_applications(spark, folder, ["app_id", "label"])
    return split.split_dataset(app, "app_id", ratios=[0.7, 0.3]).select("app_id", "split")


@query("split_stratified_three", on_app(
    "SELECT app_id, CASE WHEN rank < floor(n * 0.5::DOUBLE) THEN 'train' WHEN rank < floor(n * 0.75::DOUBLE) THEN 'valid' "
    "ELSE 'oot' END AS split FROM drawn", drawn()))
def split_stratified_three(spark, folder):
    app = kept_applications(spark, folder, ["app_id", "label"])
    return split.split_dataset(app, "app_id", ratios=[0.5, 0.25, 0.25]).select("app_id", "split")


@query("split_rest_of_time", on_app(
    "SELECT app_id, CASE WHEN d.rank < floor(d.n * (0.6::DOUBLE / (0.6::DOUBLE + 0.2::DOUBLE))) THEN 'train' WHEN d.rank IS NOT NULL THEN 'valid' "
    "ELSE 'oot' END AS split FROM app LEFT JOIN drawn d USING (app_id)", drawn("apply_time < TIMESTAMP '2000-04-01'")))
def split_rest_of_time(spark, folder):
    app = kept_applications(spark, folder, ["app_id", "apply_time", "label"])
    return split.split_dataset(app, "app_id", ratios=[0.6, 0.2, 0.2], oot_col="apply_time",
                               oot_start="2000-04-01").select("app_id", "split")


@query("split_mining", on_app(
    "SELECT app_id, CASE WHEN row_number() OVER (ORDER BY apply_time, app_id) <= floor(COUNT(*) OVER () * 0.7::DOUBLE) + 1 "
    "THEN 'train' ELSE 'test' END AS target_group FROM app"))
def split_mining(spark, folder):
    app = kept_applications(spark, folder, ["app_id", "apply_time"])
    return split.mining_split(app, "app_id", "apply_time").select("app_id", "target_group")


@query("split_union", on_app("SELECT app_id, target FROM app"))
def split_union(spark, folder):
    app = applications(spark, folder, ["app_id", "target"])
    return split.tag_union({t: app.where(F.col("target") == t).drop("target") for t in ("train", "valid", "oot")})
