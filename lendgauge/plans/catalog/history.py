"""Queries over profiles of batches (months) that are stored once and merged for spans of months."""

from pyspark.sql import functions as F

from ...operators import profile, spans
from ...operators.psi import psi_between
from ...session import new_place
from ..loanbook import applications, kept_applications
from .registry import long_part, on_app, query, rounded
from .tables import FEATURES

SPAN_END = "2000-04"
#: Differences of an exact PSI and one from sketches of 400 that are let through.
PSI_ERROR = 0.02


def stored(spark, app):
    path = new_place(spark, "profiles")
    spans.store_profiles(spans.batch_profiles(app, "month_time"), path)
    return spans.stored_profiles(spark, path)


TEXT_ROWS = "SELECT 'segment' AS feature, month_time, CAST(NULL AS DOUBLE) AS value, segment AS given FROM app"


@query("batch_profiles", on_app(
    "SELECT month_time AS batch, feature AS column_name, COUNT(*) AS n_rows, COUNT(*) FILTER (given IS NULL) AS n_missing, round(avg(value), 6) AS mean, "
    "round(min(value), 6) AS low, round(max(value), 6) AS high FROM "
    f"(SELECT feature, month_time, value, CAST(value AS VARCHAR) AS given FROM long UNION ALL {TEXT_ROWS}) GROUP BY ALL", long_part()))
def batch_profiles(spark, folder):
    profiles = stored(spark, applications(spark, folder, ["month_time", "segment", *FEATURES]))
    return rounded(profiles.select("batch", "column_name", "n_rows", "n_missing", "mean", "low", "high"))


@query("span_figures", on_app(
    "SELECT feature AS column_name, COUNT(DISTINCT month_time) AS n_batches, COUNT(*) AS n_rows, COUNT(*) FILTER (given IS NULL) AS n_missing, "
    "round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS low, round(max(value), 6) AS high, true AS distinct_within, "
    "true AS quantiles_within FROM "
    f"(SELECT feature, month_time, value, CAST(value AS VARCHAR) AS given FROM long UNION ALL {TEXT_ROWS}) WHERE month_time < '{SPAN_END}' GROUP BY ALL", long_part()))
def span_figures(spark, folder):
    """Merged figures of all months before ``SPAN_END``; estimates are held against exact ones, within their bounds."""
    app = kept_applications(spark, folder, ["month_time", "segment", *FEATURES])
    found = spans.span_figures(spans.merge_profiles(stored(spark, app).where(F.col("batch") < SPAN_END)))
    span, probabilities = app.where(F.col("month_time") < SPAN_END), (0.25, 0.5, 0.75)
    exact = profile.distinct_profile(span, ["segment", *FEATURES]).select("column_name", F.col("n_distinct").alias("values"))
    # Twice the bound of a rank, which holds in 99 of 100 cases.
    around = [p + side * 2 * spans.RANK_ERROR for p in probabilities for side in (-1, 1)]
    ends = profile.quantile_frame(span, FEATURES, around, [f"end{i}" for i in range(len(around))])
    inside = [F.col(f"q{round(p * 100)}").between(F.col(f"end{2 * i}"), F.col(f"end{2 * i + 1}")) for i, p in enumerate(probabilities)]
    checked = found.join(exact, "column_name").join(ends, "column_name", "left").withColumns({
        "distinct_within": F.abs(F.col("n_distinct") - F.col("values")) <= F.greatest(F.lit(1.0), F.col("distinct_error") * F.col("values")),
        "quantiles_within": F.coalesce(inside[0] & inside[1] & inside[2], F.col("mean").isNull())})
    return rounded(checked.select("column_name", "n_batches", "n_rows", "n_missing", "mean", "std", "low", "high", "distinct_within", "quantiles_within"))


@query("span_psi", " UNION ALL ".join(f"SELECT '{f}' AS column_name, true AS near" for f in FEATURES))
def span_psi(spark, folder):
    """PSI of the months from ``SPAN_END`` on against those before, from sketches, beside the exact one."""
    app = kept_applications(spark, folder, ["month_time", *FEATURES])
    profiles, before = stored(spark, app), F.col("month_time") < SPAN_END
    found = spans.span_psi(*[spans.merge_profiles(profiles.where(side)) for side in (F.col("batch") < SPAN_END, F.col("batch") >= SPAN_END)])
    exact = psi_between(app, FEATURES, before, ~before, method="equal_frequency").select(F.col("feature").alias("column_name"), F.col("psi").alias("exact"))
    return found.join(exact, "column_name").select("column_name", (F.abs(F.col("psi") - F.col("exact")) <= PSI_ERROR).alias("near"))
