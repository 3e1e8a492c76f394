"""Application times in the many shapes they arrive in."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Integer ranges read as yyyyMM and yyyyMMdd; other integers are unix seconds.
MONTH_CODES = (190001, 209912)
DAY_CODES = (19000101, 20991231)

# Text layouts tried in this order.
TEXT_LAYOUTS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "yyyyMMdd",
    "yyyy-MM",
]


def numeric_time(column, layout):
    c = F.col(column) if isinstance(column, str) else column
    if layout == "month":
        return F.try_to_timestamp(F.concat(c.cast("long").cast("string"), F.lit("01")), F.lit("yyyyMMdd"))
    if layout == "day":
        return F.try_to_timestamp(c.cast("long").cast("string"), F.lit("yyyyMMdd"))
    return F.timestamp_seconds(c)


def integer_layout(low, high):
    """``month``, ``day`` or ``seconds`` from the range of the whole column."""
    if low is None:
        return "seconds"
    if MONTH_CODES[0] <= low and high <= MONTH_CODES[1]:
        return "month"
    if DAY_CODES[0] <= low and high <= DAY_CODES[1]:
        return "day"
    return "seconds"


def parse_time(df: DataFrame, column, layout=None):
    """Timestamp Column for ``column``; text that fits no layout becomes null.

    Integers need their layout, taken from ``layout`` or from one min/max pass, so that the answer
    does not depend on which row happens to come first.
    """
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    if isinstance(kind, T.NumericType):
        if layout is None:
            ends = df.agg(F.min(c).alias("low"), F.max(c).alias("high")).first()
            layout = integer_layout(ends["low"], ends["high"])
        return numeric_time(c, layout)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(layout)) for layout in TEXT_LAYOUTS])


def month_of(timestamp):
    """``yyyy-MM``; null stays null."""
    return F.date_format(timestamp, "yyyy-MM")
