"""Registered queries and, where SQL can say the same, the statement that checks them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..loanbook import NUMERIC_FEATURES, SQL

QUERIES = {}
STATEMENTS = {}


def query(name, statement=None):
    """Register ``function(spark, folder)`` under ``name`` with its checking statement."""
    def register(function):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if statement:
            STATEMENTS[name] = statement
        return function
    return register


def rounded(df: DataFrame, digits=6) -> DataFrame:
    """Round doubles: sums in another order differ in the last bits."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def on_app(body, *parts):
    """Statement over the application table with further named parts before ``body``."""
    return "WITH " + ", ".join([SQL, *parts]) + "\n" + body


def r6(*names):
    """``round(x, 6) AS x`` for every name; ``(expression, name)`` pairs are allowed."""
    pairs = [(n, n) if isinstance(n, str) else n for n in names]
    return ", ".join(f"round({e}, 6) AS {n}" for e, n in pairs)


def long_part(features=NUMERIC_FEATURES, name="long", source="app"):
    """Named part with one row per application and feature."""
    rows = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, app_id, target, month_time, label, CAST({f} AS DOUBLE) AS value FROM {source}"
        for f in features)
    return f"{name} AS ({rows})"


DECILES = "[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]"


def cuts_part(where="target = 'train'", probabilities=DECILES, name="cuts", source="long"):
    """Named part with the distinct inner quantiles of every feature."""
    return (f"{name} AS (SELECT feature, list_distinct(quantile_cont(value, {probabilities})) AS cuts "
            f"FROM {source} WHERE {where} GROUP BY feature)")


def binned_part(name="binned", source="long", cuts="cuts"):
    """Named part with right-closed bins; missing values come after the last bin."""
    return (f"{name} AS (SELECT l.*, CASE WHEN l.value IS NULL THEN len(c.cuts) + 2 "
            f"ELSE 1 + len(list_filter(c.cuts, lambda c: c < l.value)) END AS bin "
            f"FROM {source} l JOIN {cuts} c USING (feature))")


def woe_part(keys, name="woe", source="binned"):
    """Named part with the full bin table per ``keys`` (which start with feature)."""
    k = ", ".join(keys)
    return f"""{name}_c AS (
  SELECT {k}, bin, CAST(COUNT(*) FILTER (label = 0) AS DOUBLE) AS good, CAST(COUNT(*) FILTER (label = 1) AS DOUBLE) AS bad,
         CAST(COUNT(*) AS DOUBLE) AS total FROM {source} GROUP BY {k}, bin),
{name}_t AS (
  SELECT *, SUM(good) OVER g AS tg, SUM(bad) OVER g AS tb, SUM(total) OVER g AS tt,
         SUM(good) OVER u AS good_cum, SUM(bad) OVER u AS bad_cum, SUM(total) OVER u AS total_cum
  FROM {name}_c WINDOW g AS (PARTITION BY {k}),
    u AS (PARTITION BY {k} ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name}_s AS (
  SELECT *, bad / total AS bad_rate, CASE WHEN good = 0 THEN 1e-4 ELSE good / tg END AS good_pct,
         CASE WHEN bad = 0 THEN 1e-4 ELSE bad / tb END AS bad_pct, total / tt AS total_pct
  FROM {name}_t),
{name} AS (
  SELECT *, ln(good_pct / bad_pct) AS woe, (good_pct - bad_pct) * ln(good_pct / bad_pct) AS iv,
         SUM((good_pct - bad_pct) * ln(good_pct / bad_pct)) OVER (PARTITION BY {k}) AS total_iv,
         bad_rate / (tb / tt) AS lift, bad_cum / total_cum AS cum_bad_rate,
         (bad_cum / total_cum) / (tb / tt) AS cum_lift, bad_cum / tb AS bad_cum_rate, good_cum / tg AS good_cum_rate,
         MAX(abs(bad_cum / tb - good_cum / tg)) OVER (PARTITION BY {k}) AS ks
  FROM {name}_s)"""


WOE_COLUMNS = ("bad_rate", "good_pct", "bad_pct", "total_pct", "woe", "iv", "total_iv", "lift", "cum_bad_rate",
               "cum_lift", "bad_cum_rate", "good_cum_rate", "ks")


def woe_select(keys):
    counts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("good", "bad", "total", "bad_cum", "total_cum"))
    return f"SELECT {', '.join(keys)}, CAST(bin AS INT) AS bin, {counts}, {r6(*WOE_COLUMNS)} FROM woe"


def woe_columns(table: DataFrame, keys) -> DataFrame:
    return rounded(table.select(*keys, "bin", "good", "bad", "total", "bad_cum", "total_cum", *WOE_COLUMNS))
