"""Old against new strategy: who is swapped in and out, and what the swapped-in are likely to do.

One aggregation reduces the table to counts per (old decision, new decision, labelled, score bin);
every figure is taken from that table of a few dozen rows.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bins import bin_number, with_infinite_ends
from ..functions.guards import ratio
from ..functions.predicates import as_rule, compile_rules
from .binning import edge_frame
from .ranks import SMALL_GROUP, quantiles

INFERENCE_BINS = 6


def swap_hits(df: DataFrame, old_rules, new_rules, old_logic="and", new_logic="and", old_type="reject",
              new_type="reject"):
    """(old hit, new hit) Columns, true for rejected; an empty rule list hits nobody."""
    hits = []
    for rules, logic, kind in ((old_rules, old_logic, old_type), (new_rules, new_logic, new_type)):
        matched = compile_rules(df, rules, logic, missing="false") if rules else None
        if matched is None:
            hits.append(F.lit(False))
        else:
            hits.append(~matched if kind == "approve" else matched)
    return hits


def check_fields(df: DataFrame, rules):
    unknown = [as_rule(r).field for r in rules if as_rule(r).field not in df.columns]
    if unknown:
        raise ValueError(f"fields not in the table: {unknown}")


def choose_score_field(rules, given=None):
    """The field whose bins carry the inference: given, a scored one, or that of the first new rule."""
    if given:
        return given
    fields = [as_rule(r).field for r in rules]
    return next((f for f in fields if f.startswith("_model_result_") or "score" in f.lower()), fields[0])


def swap_cells(df: DataFrame, old_rules, new_rules, label="label", score=None, nodes=None, old_logic="and",
               new_logic="and", old_type="reject", new_type="reject", small_group=SMALL_GROUP):
    """((old_hit, new_hit, labelled, bin, n, bad), edges)."""
    check_fields(df, list(old_rules) + list(new_rules))
    field = choose_score_field(new_rules, score)
    old, new = swap_hits(df, old_rules, new_rules, old_logic, new_logic, old_type, new_type)
    rows = df.select(old.alias("old_hit"), new.alias("new_hit"), F.col(label).alias("_y"),
                     F.col(f"`{field}`").try_cast("double").alias("_score"))
    if nodes is None:
        labelled = rows.where(F.col("_y").isNotNull())
        nodes = quantiles(labelled, ["_score"], [i / INFERENCE_BINS for i in range(INFERENCE_BINS + 1)], (),
                          small_group)[()]["_score"] or []
    edges = with_infinite_ends(nodes)
    cells = rows.groupBy(
        "old_hit", "new_hit", F.col("_y").isNotNull().alias("labelled"),
        bin_number(F.col("_score"), edges, "left").alias("bin")).agg(
            F.count("*").alias("n"), F.sum(F.col("_y").cast("int")).cast("bigint").alias("bad"))
    return cells, edges


def _count(condition, column="n"):
    return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0))




def decision_matrix(cells: DataFrame) -> DataFrame:
    """One row: rows per pair of decisions, zero-filled."""
    old, new = F.col("old_hit"), F.col("new_hit")
    return cells.agg(
        _count(~old & ~new).alias("both_pass"), _count(~old & new).alias("swap_out"),
        _count(old & ~new).alias("swap_in"), _count(old & new).alias("both_reject"), _count(F.lit(True)).alias("total"))


def bad_matrix(cells: DataFrame) -> DataFrame:
    """One row: bads among labelled rows per pair of decisions; null where no row is labelled."""
    old, new = F.col("old_hit"), F.col("new_hit")

    def bads(condition):
        return F.sum(F.when(condition & F.col("labelled"), F.col("bad")))

    return cells.agg(bads(~old & ~new).alias("both_pass_bad"), bads(~old & new).alias("swap_out_bad"),
                     bads(old & ~new).alias("swap_in_bad"), bads(old & new).alias("both_reject_bad"))


def _inference(cells, edges):
    spark = cells.sparkSession
    bins = edge_frame(spark, {"score": edges}, "left", with_missing=False).drop("feature")
    swapped_in = ~F.col("labelled") & F.col("old_hit") & ~F.col("new_hit")
    per_bin = cells.groupBy("bin").agg(
        _count(F.col("labelled")).alias("pass_count"), _count(F.col("labelled"), "bad").alias("pass_bad"),
        _count(swapped_in).alias("reject_cnt"))
    joined = bins.join(per_bin, "bin", "left").na.fill(0, ["pass_count", "pass_bad", "reject_cnt"])
    return joined.withColumn("badrate", F.try_divide("pass_bad", "pass_count")).withColumn(
        "est_bad_cnt", F.col("reject_cnt") * F.col("badrate"))


def inference_table(cells: DataFrame, edges) -> DataFrame:
    """Per score bin: labelled rows, their bad rate and lift, swapped-in rows and their expected bads."""
    whole = cells.agg((_count(F.col("labelled"), "bad") / _count(F.col("labelled"))).alias("base")).first()["base"]
    rows = _inference(cells, edges)
    return rows.select(
        "bin", "low", "high", "bin_range", "pass_count", "pass_bad", F.round("badrate", 4).alias("badrate"),
        F.round(F.col("badrate") / F.lit(whole), 4).alias("lift") if whole else F.lit(None).cast("double").alias("lift"),
        "reject_cnt", F.round("est_bad_cnt", 2).alias("est_bad_cnt"))


def swap_summary(cells: DataFrame, edges) -> DataFrame:
    """One row with the decision matrix, swap-in and swap-out figures, pass rates and bad rates.

    ``swap_out_cell_badrate`` divides the labelled bads by all rows of the cell,
    ``swap_out_badrate`` by its labelled rows.
    """
    old, new, labelled = F.col("old_hit"), F.col("new_hit"), F.col("labelled")
    est = _inference(cells, edges).agg(F.coalesce(F.sum("est_bad_cnt"), F.lit(0.0)).alias("e")).first()["e"]
    sums = cells.agg(
        _count(F.lit(True)).alias("total"),
        _count(~old & ~new).alias("both_pass"), _count(~old & new).alias("swap_out_count"),
        _count(old & ~new).alias("old_reject_new_pass"), _count(old & new).alias("both_reject"),
        _count(~labelled & old & ~new).alias("swap_in_count"),
        _count(labelled).alias("_l"), _count(labelled, "bad").alias("_lb"),
        _count(labelled & ~old).alias("_lo"), _count(labelled & ~old, "bad").alias("_lob"),
        _count(labelled & ~new).alias("_ln"), _count(labelled & ~new, "bad").alias("_lnb"),
        _count(labelled & ~old & ~new, "bad").alias("_bpb"),
        _count(labelled & ~old & new).alias("_so"), _count(labelled & ~old & new, "bad").alias("swap_out_bad"))
    e = F.lit(float(est))
    old_pass = F.col("both_pass") + F.col("swap_out_count")
    new_pass = F.col("both_pass") + F.col("old_reject_new_pass")
    old_rate, new_rate = ratio(old_pass, "total"), ratio(new_pass, "total")
    old_bad = ratio("_lob", "_lo")
    new_bad = ratio(F.col("_lnb") + e, F.col("_ln") + F.col("swap_in_count"))
    return sums.select(
        "total", "both_pass", "swap_out_count", "old_reject_new_pass", "both_reject", "swap_in_count",
        F.round(e, 1).alias("swap_in_est_bad"), F.round(ratio(e, "swap_in_count"), 4).alias("swap_in_est_badrate"),
        "swap_out_bad", F.round(ratio("swap_out_bad", "_so"), 4).alias("swap_out_badrate"),
        F.round(F.try_divide("_bpb", "both_pass"), 4).alias("both_pass_cell_badrate"),
        F.round(F.try_divide("swap_out_bad", "swap_out_count"), 4).alias("swap_out_cell_badrate"),
        old_pass.alias("old_pass_count"), new_pass.alias("new_pass_count"),
        F.round(old_rate, 4).alias("old_pass_rate"), F.round(new_rate, 4).alias("new_pass_rate"),
        F.round(new_rate - old_rate, 4).alias("pass_rate_delta"),
        F.round(old_bad, 4).alias("old_badrate"), F.round(new_bad, 4).alias("new_badrate"),
        F.round(new_bad - old_bad, 4).alias("badrate_delta"),
        F.round(F.try_divide("_lb", "_l"), 4).alias("overall_badrate"))
