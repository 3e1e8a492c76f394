"""Strategies over applications: one-off analysis, ordered flows and comparisons.

A row leaves a flow at its first intercepting node, so one integer per row, the number of that node
(0 for none), holds everything; every figure comes from counting rows per number.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import is_numeric, ratio
from ..functions.predicates import RULE_TYPES, as_rule, compile_rules, text_columns_with_numbers

# Label columns looked for, in this order.
LABEL_NAMES = ("label", "target", "bad_ind", "is_bad")


def find_label(df: DataFrame):
    """First numeric column with a known label name, else the last one whose name holds bad or label."""
    numeric = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    for name in LABEL_NAMES:
        if name in numeric:
            return name
    return next((c for c in reversed(numeric) if "bad" in c.lower() or "label" in c.lower()), None)


def analyse_rules(df: DataFrame, rules, combine_logic="and", rule_type="reject", label=None) -> DataFrame:
    """One row of counts and rates of a rule set used alone; unknown fields are skipped.

    ``hit`` means rejected: the rules match (reject) or do not match (approve). Label figures are
    null when the table has no label column.
    """
    if rule_type not in RULE_TYPES:
        raise ValueError(f"rule_type must be one of {RULE_TYPES}")
    matched = compile_rules(df, rules, combine_logic, missing="skip")
    if matched is None:
        raise ValueError("no valid rule")
    hit = ~matched if rule_type == "approve" else matched
    label = label or find_label(df)
    y = F.col(f"`{label}`").cast("double") if label else F.lit(None).cast("double")
    counted = df.select(hit.alias("_hit"), y.alias("_y")).agg(
        F.count("*").alias("total_count"), F.count_if("_hit").alias("hit_count"),
        F.count_if(~F.col("_hit")).alias("pass_count"),
        F.sum("_y").cast("bigint").alias("total_bad"), F.sum(F.when(F.col("_hit"), F.col("_y"))).cast("bigint").alias("_hb"),
        F.sum(F.when(~F.col("_hit"), F.col("_y"))).cast("bigint").alias("_pb"))
    if label:
        counted = counted.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total_bad", "_hb", "_pb")})
    base = ratio("total_bad", "total_count")
    share = F.lit(None).cast("double") if not label else None

    def labelled(column):
        return column if label else share

    return counted.select(
        "total_count", "hit_count", "pass_count",
        F.round(ratio("pass_count", "total_count"), 4).alias("approval_rate"),
        F.round(ratio("hit_count", "total_count"), 4).alias("rejection_rate"),
        "total_bad", F.col("_hb").alias("hit_bad"),
        labelled(F.round(ratio("_hb", "total_bad"), 4)).alias("bad_capture_rate"),
        labelled(F.round(ratio("_pb", "pass_count"), 4)).alias("pass_bad_rate"),
        labelled(F.round(base, 4)).alias("base_bad_rate"),
        labelled(F.round(ratio(ratio("_hb", "hit_count"), base), 2)).alias("lift"))


def ordered(strategies, active_only=False):
    """Strategies by ascending priority."""
    chosen = [s for s in strategies if not active_only or s.status == "active"]
    return sorted(chosen, key=lambda s: s.priority)


def _nodes(df, strategies):
    """[(strategy, pass condition or None)] in the given order."""
    every = [r for s in strategies for r in s.rules]
    numbers = text_columns_with_numbers(df, every)
    nodes = []
    for s in strategies:
        matched = compile_rules(df, s.rules, s.combine_logic, "skip", numbers)
        passed = None if matched is None else (~matched if s.rule_type == "reject" else matched)
        nodes.append((s, passed))
    return nodes


def _leaving_node(nodes):
    """Number of the first node that intercepts the row, 0 for none."""
    steps = [F.when(~passed, n) for n, (_, passed) in enumerate(nodes, 1) if passed is not None]
    return F.coalesce(*steps, F.lit(0)).cast("int")


def _decisions(nodes):
    """Decision per leaving node: 1 passed explicitly, -1 rejected, 0 undecided.

    A row that reaches a node has passed all nodes before it, so an approval earlier in the flow
    stands unless a reject node intercepts the row; an approve node that intercepts only stops it.
    """
    decisions, approved = {}, 0
    for n, (s, passed) in enumerate(nodes, 1):
        if passed is not None:
            decisions[n] = -1 if s.rule_type == "reject" else approved
            if s.rule_type == "approve":
                approved = 1
    decisions[0] = approved
    return decisions


def _passes(nodes):
    """Leaving nodes whose rows count as passed in the end."""
    wanted = 1 if any(s.rule_type == "approve" for s, _ in nodes) else 0
    return [n for n, d in _decisions(nodes).items() if d == wanted]


def decide(df: DataFrame, strategies) -> DataFrame:
    """Row-level outcome: ``leaving_node``, ``decision`` (-1, 0, 1) and ``passed``."""
    nodes = _nodes(df, strategies)
    table = _decisions(nodes)
    node = F.col("leaving_node")
    decision = reduce(lambda rest, n: F.when(node == n, table[n]).otherwise(rest), table, F.lit(0))
    return df.withColumn("leaving_node", _leaving_node(nodes)).withColumns(
        {"decision": decision.cast("int"), "passed": node.isin(_passes(nodes))})


def _node_table(counts, nodes, spark):
    """Node figures from (leaving_node, n)."""
    listed = spark.createDataFrame(
        [(n, s.id, s.name, s.rule_type) for n, (s, _) in enumerate(nodes, 1)] + [(0, None, None, None)],
        "node int, id long, name string, rule_type string")
    joined = listed.join(counts, listed["node"] == counts["leaving_node"], "left").select(
        listed["*"], F.coalesce("n", F.lit(0)).alias("n"))
    flow = Window.partitionBy(F.lit(1))
    before = flow.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    # Node 0 collects the rows that stay to the end; it is no node of the flow.
    cut = F.when(F.col("node") > 0, F.col("n")).otherwise(0)
    stats = joined.withColumns({
        "_total": F.sum("n").over(flow), "_gone": F.coalesce(F.sum(cut).over(before), F.lit(0))})
    stats = stats.where(F.col("node") > 0).withColumn("node_input_count", F.col("_total") - F.col("_gone"))
    stats = stats.withColumn("pass_count", F.col("node_input_count") - F.col("n"))
    idle = [n for n, (_, passed) in enumerate(nodes, 1) if passed is None]
    no_rule = F.col("node").isin(idle) if idle else F.lit(False)
    return stats.select(
        "node", "id", "name", "rule_type", "node_input_count", F.col("n").alias("intercept_count"), "pass_count",
        F.round(ratio("n", "node_input_count"), 4).alias("node_intercept_rate"),
        F.when(no_rule, 1.0).otherwise(F.round(ratio("pass_count", "node_input_count"), 4)).alias("node_pass_rate"),
        F.round(ratio("n", "_total"), 4).alias("global_intercept_rate"),
        F.round(ratio("pass_count", "_total"), 4).alias("global_pass_rate"))


def flow_nodes(df: DataFrame, strategies) -> DataFrame:
    """Figures of every node of an ordered flow from one aggregation."""
    nodes = _nodes(df, strategies)
    counts = df.select(_leaving_node(nodes).alias("leaving_node")).groupBy("leaving_node").agg(F.count("*").alias("n"))
    return _node_table(counts, nodes, df.sparkSession)


def _totals(counts, nodes):
    passing = F.col("leaving_node").isin(_passes(nodes))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_count"),
        F.coalesce(F.sum(F.when(passing, F.col("n")).otherwise(0)), F.lit(0)).alias("pass_count")).select(
        "total_count", "pass_count", (F.col("total_count") - F.col("pass_count")).alias("hit_count"),
        F.round(ratio("pass_count", "total_count"), 4).alias("approval_rate"))


def flow_summary(df: DataFrame, strategies) -> DataFrame:
    """One row: total, passed, rejected, approval rate. Without strategies every row passes."""
    nodes = _nodes(df, strategies)
    counts = df.select(_leaving_node(nodes).alias("leaving_node")).groupBy("leaving_node").agg(F.count("*").alias("n"))
    return _totals(counts, nodes)


def flow_funnel(df: DataFrame, strategies) -> DataFrame:
    """(step, name, survival): everything at step 0, then the global pass rate after each node."""
    nodes = flow_nodes(df, strategies).select(
        F.col("node").alias("step"), "name", F.col("global_pass_rate").alias("survival"))
    start = df.sparkSession.createDataFrame([(0, "all", 1.0)], "step int, name string, survival double")
    return start.unionByName(nodes)


def compare_flows(df: DataFrame, baseline, experiment) -> DataFrame:
    """One row with both outcomes and their differences; both flows share one aggregation."""
    old, new = _nodes(df, ordered(baseline)), _nodes(df, ordered(experiment))
    cells = df.select(_leaving_node(old).alias("_old"), _leaving_node(new).alias("_new")).groupBy("_old", "_new").agg(
        F.count("*").alias("n"))

    def passed(column, nodes):
        return F.coalesce(F.sum(F.when(F.col(column).isin(_passes(nodes)), F.col("n")).otherwise(0)), F.lit(0))

    totals = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_count"), passed("_old", old).alias("baseline_pass_count"),
                       passed("_new", new).alias("experiment_pass_count"))
    t, old_pass, new_pass = (F.col(c) for c in totals.columns)
    return totals.select(
        "total_count", "baseline_pass_count", (t - old_pass).alias("baseline_hit_count"),
        F.round(ratio(old_pass, t), 4).alias("baseline_approval_rate"),
        "experiment_pass_count", (t - new_pass).alias("experiment_hit_count"),
        F.round(ratio(new_pass, t), 4).alias("experiment_approval_rate"),
        F.round(F.round(ratio(new_pass, t), 4) - F.round(ratio(old_pass, t), 4), 4).alias("approval_rate_delta"),
        (old_pass - new_pass).alias("hit_count_delta"), (new_pass - old_pass).alias("pass_count_delta"))


def compare_nodes(df: DataFrame, baseline, experiment) -> DataFrame:
    """Node figures of both flows under ``flow``: still one aggregation over the table."""
    flows = {"baseline": _nodes(df, ordered(baseline)), "experiment": _nodes(df, ordered(experiment))}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("flow"), _leaving_node(nodes).alias("leaving_node")) for name, nodes in flows.items()
    ])).alias("v")).select("v.*")
    counts = long.groupBy("flow", "leaving_node").agg(F.count("*").alias("n"))
    parts = [
        _node_table(counts.where(F.col("flow") == name).drop("flow"), nodes, df.sparkSession).withColumn("flow", F.lit(name))
        for name, nodes in flows.items()]
    return parts[0].unionByName(parts[1])


__all__ = ["analyse_rules", "as_rule", "compare_flows", "compare_nodes", "decide", "find_label", "flow_funnel",
           "flow_nodes", "flow_summary", "ordered"]
