"""Column guards for ratios, logarithms and non-finite numbers under ANSI mode."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Shares of zero are replaced by these before taking a logarithm.
WOE_EPSILON = 1e-4
PSI_EPSILON = 1e-6
SIMPLE_IV_EPSILON = 1e-10


def ratio(numerator, denominator, default=0.0) -> Column:
    """``numerator / denominator`` where the denominator is positive, else ``default``."""
    num, den = _column(numerator), _column(denominator)
    return F.when(den > 0, F.try_divide(num.cast("double"), den.cast("double"))).otherwise(F.lit(default))


def smooth(share, epsilon) -> Column:
    """Replace a share of exactly zero by ``epsilon``."""
    return F.when(_column(share) == 0, F.lit(epsilon)).otherwise(_column(share))


def clip(column, low, high) -> Column:
    """Limit to ``[low, high]``; null stays null (``least``/``greatest`` alone would skip it)."""
    c = _column(column)
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def finite(column) -> Column:
    """Null for NaN and both infinities."""
    c = _column(column).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def finite_or_zero(column) -> Column:
    """Zero for null, NaN and both infinities."""
    return F.coalesce(finite(column), F.lit(0.0))


def psi_term(actual, expected) -> Column:
    """One summand of the population stability index for two positive shares."""
    a, e = _column(actual), _column(expected)
    return (a - e) * F.ln(a / e)


def numeric(column) -> Column:
    """Number in the column or null; never raises on text that is not a number."""
    c = _column(column)
    return c.try_cast("double")


def is_numeric(data_type) -> bool:
    return isinstance(data_type, T.NumericType)


def numeric_columns(df, narrow=False):
    """Names of numeric columns; ``narrow`` keeps int32, int64, float32 and float64 only."""
    kinds = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType) if narrow else T.NumericType
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)
