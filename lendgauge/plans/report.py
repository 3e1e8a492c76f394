"""The whole model report from one scored table."""

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.periods import month_of, parse_time
from ..operators.binning import equal_frequency_cuts
from ..operators.clean import with_weight
from ..operators.evaluate import data_summary, lift_table, performance_table
from ..operators.psi import report_month_psi, report_psi
from ..operators.ranks import SMALL_GROUP
from ..operators.train import importance_table
from ..operators.woe import detail_report, iv_by_set, ks_by_set, learn_edges
from ..sources.tables import write_sections


def scored_table(df: DataFrame, model, time_col=None, target="target") -> DataFrame:
    """Everything the report reads: features, label, split, weight, month, probability and score."""
    scored = with_weight(model.score(df))
    month = month_of(parse_time(df, time_col)) if time_col else F.lit(None).cast("string")
    columns = list(dict.fromkeys([*model.features, model.label, target, "weight", "proba", "score"]))
    return scored.withColumn("month_time", month).select(*columns, "month_time")


def model_report(scored: DataFrame, features, label="label", target="target", model=None, scale=None, edges=None,
                 max_leaf_nodes=6, min_samples_leaf=0.05, small_group=SMALL_GROUP):
    """``{section: DataFrame}`` with bins learned on train.

    The caller keeps ``scored`` persisted while the sections are read.
    """
    edges = edges or learn_edges(scored, features, label, target, "tree", max_leaf_nodes, min_samples_leaf)
    proba_cuts = equal_frequency_cuts(scored.where(F.col(target) == "train"), ["proba"], 10, small_group)["proba"]
    iv, ks = iv_by_set(scored, edges, label=label, target=target), ks_by_set(scored, edges, label=label, target=target)
    score = "score" if "score" in scored.columns else "proba"
    sections = {
        "data_summary": data_summary(scored, label, target),
        "performance": performance_table(scored, "proba", label, target, small_group=small_group),
        "feature_importance": importance_table(model, iv, ks) if model else iv.join(ks, "feature"),
        "bin_details": detail_report(scored, edges, "all", label, target),
        "lift_table": lift_table(scored, score, label, target, small_group=small_group),
        "psi_train_oot": report_psi(scored, "proba", target, proba_cuts),
        "psi_monthly": report_month_psi(scored, "proba", "month_time", target, proba_cuts),
    }
    if scale:
        sections["scaling"] = scored.sparkSession.createDataFrame(
            [(k, str(v)) for k, v in scale.items()], "setting string, value string")
    return sections


def write_model_report(df: DataFrame, model, folder, time_col=None, target="target") -> dict:
    """Score once, keep the scored table while all sections are written, and return their paths."""
    scored = scored_table(df, model, time_col, target).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        numeric = [c for c in model.features if c not in model.text_features]
        return write_sections(model_report(scored, numeric, model.label, target, model, model.score_config), folder)
    finally:
        scored.unpersist()
