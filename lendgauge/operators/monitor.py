"""Monitoring of scored batches and of strategies, and the logs they leave."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .evaluate import score_histogram
from .psi import psi_from_distribution, stability_band
from .scoring import with_model_scores
from .strategy import compare_flows, compare_nodes, flow_nodes, flow_summary, ordered


def monitor_scores(df: DataFrame, distribution, score="score", batch_name="batch") -> DataFrame:
    """One log row of a scored batch: size, PSI against the stored distribution, mean, min, max, std, histogram."""
    figures = score_histogram(df, score)
    shift = psi_from_distribution(df, score, distribution).first()["psi"] if distribution else 0.0
    return figures.select(
        F.lit(batch_name).alias("batch_name"), "sample_size", F.lit(shift).cast("double").alias("psi"), "avg_score",
        "min_score", "max_score", "std_score", "bins", "counts")


def monitor_model(model, df: DataFrame, batch_name="batch") -> DataFrame:
    """Score a batch with a saved model and describe it as one log row. Scores are kept: the model runs once a row."""
    scored = checkpointed(model.score(df).select("score"))
    return monitor_scores(scored, model.score_distribution, "score", batch_name)


def monitor_strategies(df: DataFrame, strategies, models=None, batch_name="batch") -> DataFrame:
    """One log row of a flow over a batch; node figures are nested in ``nodes``."""
    active = ordered(strategies, active_only=True)
    scored = with_model_scores(df, [r for s in active for r in s.rules], models or {})
    return _with_nodes(flow_summary(scored, active), flow_nodes(scored, active)).withColumn("batch_name", F.lit(batch_name))


def monitor_comparison(df: DataFrame, baseline, experiment, models=None, batch_name="batch") -> DataFrame:
    """One log row of two flows over the same batch."""
    scored = with_model_scores(df, [r for s in [*baseline, *experiment] for r in s.rules], models or {})
    return _with_nodes(compare_flows(scored, baseline, experiment), compare_nodes(scored, baseline, experiment)).withColumn(
        "batch_name", F.lit(batch_name))


def _with_nodes(summary, nodes):
    """Attach the few node rows to the one summary row as a sorted array."""
    nested = nodes.agg(F.array_sort(F.collect_list(F.struct(*nodes.columns))).alias("nodes"))
    left, right = summary.withColumn("_one", F.lit(1)), nested.withColumn("_one", F.lit(1))
    return left.join(F.broadcast(right), "_one").drop("_one")


def recent_logs(logs: DataFrame, n=20) -> DataFrame:
    """The newest log rows with their stability band (top-k report)."""
    newest = logs.orderBy(F.desc("created_at")).limit(n)
    return newest.withColumn("band", stability_band("psi")) if "psi" in logs.columns else newest


def psi_trend(logs: DataFrame, n=20) -> DataFrame:
    """The newest log rows in time order with the change of PSI from one to the next."""
    timed = Window.partitionBy(F.lit(1)).orderBy("created_at")
    return recent_logs(logs, n).withColumn("psi_change", F.col("psi") - F.lag("psi").over(timed)).orderBy("created_at")
