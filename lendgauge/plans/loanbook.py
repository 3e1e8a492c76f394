"""The application table used throughout: one row per order, with a label and a split tag."""

from pyspark import StorageLevel
from pyspark.sql import functions as F

ITEM_COLUMNS = ("n_items", "qty", "avg_disc", "max_tax", "n_ret")
CUSTOMER_COLUMNS = ("balance", "segment", "label")
NUMERIC_FEATURES = ["amount", "balance", "n_items", "qty", "avg_disc", "max_tax", "n_ret"]
OOT_START = "2000-04-01 00:00:00"

SQL = """
li AS (
  SELECT l_orderkey, COUNT(*) AS n_items, SUM(l_quantity) AS qty,
         ROUND(AVG(l_discount), 6) AS avg_disc, MAX(l_tax) AS max_tax,
         SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_ret
  FROM lineitem GROUP BY l_orderkey),
app AS (
  SELECT o.o_orderkey AS app_id, o.o_orderdate AS apply_time,
    CAST(year(o.o_orderdate) * 100 + month(o.o_orderdate) AS INT) AS apply_month,
    strftime(o.o_orderdate, '%Y-%m') AS month_time,
    o.o_totalprice AS amount, c.c_acctbal AS balance,
    c.c_mktsegment AS segment, o.o_orderpriority AS priority,
    CAST(li.n_items AS DOUBLE) AS n_items, CAST(li.qty AS DOUBLE) AS qty, li.avg_disc AS avg_disc,
    li.max_tax AS max_tax, CAST(li.n_ret AS DOUBLE) AS n_ret,
    CAST(CASE WHEN (o.o_orderkey * 7919 + o.o_custkey * 104729) % 1000
         < 40 + CAST(0.0004 AS DOUBLE) * o.o_totalprice
           + (CASE WHEN c.c_acctbal < 1000 THEN 80 ELSE 0 END)
         THEN 1 ELSE 0 END AS INT) AS label,
    CASE WHEN o.o_orderdate >= TIMESTAMP '2000-04-01 00:00:00' THEN 'oot'
         WHEN o.o_orderkey % 4 = 3 THEN 'valid' ELSE 'train' END AS target,
    CAST(1 + o.o_orderkey % 3 AS DOUBLE) AS weight,
    CAST(0.02 AS DOUBLE) + CAST(0.9 AS DOUBLE) * o.o_totalprice / 500000 AS proba
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN li ON o.o_orderkey = li.l_orderkey)"""


def applications(spark, folder, columns=None):
    """The application table; tables behind columns that are not asked for are not read.

    There is one row per order, whichever columns are asked for; an order without a customer has null customer columns.
    """
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    wanted = list(columns) if columns else None
    needs_items = wanted is None or bool(set(wanted) & set(ITEM_COLUMNS))
    needs_customer = wanted is None or bool(set(wanted) & set(CUSTOMER_COLUMNS))

    base = orders
    if needs_customer:
        customer = spark.read.parquet(f"{folder}/customer.parquet")
        base = base.join(customer, base["o_custkey"] == customer["c_custkey"], "left")
    if needs_items:
        lineitem = spark.read.parquet(f"{folder}/lineitem.parquet")
        items = lineitem.groupBy("l_orderkey").agg(
            F.count("*").cast("double").alias("n_items"),
            F.sum("l_quantity").cast("double").alias("qty"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.max("l_tax").alias("max_tax"),
            F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("double").alias("n_ret"),
        )
        base = base.join(items, base["o_orderkey"] == items["l_orderkey"], "left")

    key, time, price = F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_totalprice")
    parts = {
        "app_id": key,
        "apply_time": time,
        "apply_month": (F.year(time) * 100 + F.month(time)).cast("int"),
        "month_time": F.date_format(time, "yyyy-MM"),
        "amount": price,
        "priority": F.col("o_orderpriority"),
        "target": F.when(time >= F.lit(OOT_START).cast("timestamp_ntz"), "oot")
        .when(key % 4 == 3, "valid").otherwise("train"),
        "weight": (1 + key % 3).cast("double"),
        "proba": F.lit(0.02) + F.lit(0.9) * price / 500000,
    }
    if needs_customer:
        balance = F.col("c_acctbal")
        draw = (key * 7919 + F.col("o_custkey") * 104729) % 1000
        limit = 40 + F.lit(0.0004) * price + F.when(balance < 1000, 80).otherwise(0)
        parts.update(balance=balance, segment=F.col("c_mktsegment"),
                     label=F.when(draw < limit, 1).otherwise(0).cast("int"))
    if needs_items:
        parts.update({c: F.col(c) for c in ITEM_COLUMNS})
    order = ["app_id", "apply_time", "apply_month", "month_time", "amount", "balance", "segment", "priority",
             *ITEM_COLUMNS, "label", "target", "weight", "proba"]
    return base.select(*[parts[c].alias(c) for c in (wanted or order)])


_KEPT = []


def kept_applications(spark, folder, columns=None):
    """The wanted columns of the application table, kept for operators that pass over them several times.

    The table is a join of three tables; its few wanted columns are held in memory or on local disk
    and recomputed where an executor is lost. The one kept before is released, so at most one is held.
    """
    while _KEPT:
        _KEPT.pop().unpersist()
    table = applications(spark, folder, columns).persist(StorageLevel.MEMORY_AND_DISK)
    _KEPT.append(table)
    return table
