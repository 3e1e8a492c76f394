"""Queries on rules, strategies, swaps and mined rules."""

from pyspark.sql import functions as F

from ...functions.predicates import Rule, Strategy, compile_rule, compile_rules, parse_rules
from ...operators import strategy, swap
from ..loanbook import applications, kept_applications
from .models import SCORED, scored
from .registry import on_app, query

COLUMNS = ["app_id", "amount", "balance", "segment", "priority", "n_items", "qty", "label"]


def app_with_text(spark, folder, columns=COLUMNS):
    """``amount_text`` holds the amount as text, and no number where the balance is negative."""
    app = applications(spark, folder, columns)
    return app.withColumn("amount_text", F.when(F.col("balance") < 0, "n/a").otherwise(F.col("amount").cast("string")))


# ---------------------------------------------------------------- rules

@query("rule_predicates", on_app("""
SELECT app_id, COALESCE(amount > 300000, false) AS above, COALESCE(n_items <= 2, false) AS few, COALESCE(n_items <> 3, true) AS not_three,
  segment = 'BUILDING' AS building, segment > 'C' AS after_c, COALESCE(balance >= 0 AND amount >= 400000, false) AS text_number,
  n_items IS NULL OR n_items <> 2 AS not_equal_null, false AS unknown_field FROM app"""))
def rule_predicates(spark, folder):
    app = app_with_text(spark, folder)
    rules = {
        "above": Rule("amount", ">", "300000"), "few": Rule("n_items", "<=", 2), "not_three": Rule("n_items", "!=", 3),
        "building": Rule("segment", "==", "BUILDING"), "after_c": Rule("segment", ">", "C"),
        "text_number": Rule("amount_text", ">=", 400000), "not_equal_null": Rule("n_items", "!=", "2")}
    kinds = {f.name: f.dataType for f in app.schema.fields}
    return app.select("app_id", *[compile_rule(r, kinds, {"amount_text"}).alias(n) for n, r in rules.items()],
                      compile_rule(Rule("nowhere", ">", 1), kinds, set(), "false").alias("unknown_field"))


@query("rule_membership", on_app(
    "SELECT app_id, segment IN ('BUILDING', 'MACHINERY') AS listed, COALESCE(CAST(n_items AS VARCHAR) IN ('1.0', '3.0'), false) AS counted FROM app"))
def rule_membership(spark, folder):
    app = applications(spark, folder, COLUMNS)
    kinds = {f.name: f.dataType for f in app.schema.fields}
    return app.select(
        "app_id", compile_rule(Rule("segment", "in", "BUILDING, MACHINERY"), kinds, set(), "false").alias("listed"),
        compile_rule(Rule("n_items", "in", [1.0, 3.0]), kinds, set(), "false").alias("counted"))


@query("rule_combination", on_app("""
SELECT app_id, COALESCE(amount > 300000, false) AND balance <= 1000 AS both, COALESCE(amount > 300000, false) OR balance <= 1000 AS either,
  NOT (COALESCE(amount > 300000, false) AND balance <= 1000) AS approve_misses FROM app"""))
def rule_combination(spark, folder):
    app = applications(spark, folder, COLUMNS)
    rules = parse_rules("amount > 300000 and balance <= 1000")
    return app.select("app_id", compile_rules(app, rules).alias("both"), compile_rules(app, rules, "or").alias("either"),
                      (~compile_rules(app, rules)).alias("approve_misses"))


@query("rule_text", on_app(
    "SELECT app_id, score < 590 AND segment <> 'FURNITURE' AND COALESCE(qty >= 50.5, false) AS hit FROM scored", SCORED))
def rule_text(spark, folder):
    app = scored(spark, folder, ["app_id", "segment", "qty"])
    return app.select("app_id", compile_rules(app, parse_rules(
        "Score < 590 and segment != FURNITURE and qty >= 50.5", score_field="score")).alias("hit"))


def analysis_sql(hit):
    return on_app(f"""
SELECT COUNT(*) AS total_count, COUNT(*) FILTER (h) AS hit_count, COUNT(*) FILTER (NOT h) AS pass_count,
  round(COUNT(*) FILTER (NOT h) / COUNT(*), 4) AS approval_rate, round(COUNT(*) FILTER (h) / COUNT(*), 4) AS rejection_rate,
  CAST(SUM(label) AS BIGINT) AS total_bad, CAST(COALESCE(SUM(label) FILTER (h), 0) AS BIGINT) AS hit_bad,
  round(COALESCE(SUM(label) FILTER (h), 0) / SUM(label), 4) AS bad_capture_rate, round(avg(label) FILTER (NOT h), 4) AS pass_bad_rate,
  round(avg(label), 4) AS base_bad_rate, round(avg(label) FILTER (h) / avg(label), 2) AS lift FROM a""",
                  f"a AS (SELECT *, {hit} AS h FROM app)")


@query("strategy_analysis", analysis_sql("COALESCE(amount > 350000, false) AND balance < 2000"))
def strategy_analysis(spark, folder):
    app = applications(spark, folder, COLUMNS)
    return strategy.analyse_rules(app, ["amount > 350000", "balance < 2000", "nowhere == 1"])


@query("strategy_analysis_approve", analysis_sql("NOT (COALESCE(n_items >= 3, false) OR segment = 'MACHINERY')"))
def strategy_analysis_approve(spark, folder):
    app = applications(spark, folder, COLUMNS)
    return strategy.analyse_rules(app, ["n_items >= 3", "segment == MACHINERY"], "or", "approve")


@query("label_discovery", on_app("SELECT CAST(SUM(label) AS BIGINT) AS bads FROM app"))
def label_discovery(spark, folder):
    app = applications(spark, folder, ["amount", "label"]).withColumnRenamed("label", "final_bad_flag")
    return app.agg(F.sum(strategy.find_label(app)).alias("bads"))


# ---------------------------------------------------------------- flows

BASELINE = [
    Strategy(11, "high amount", ["amount > 450000"], "and", "reject", 1),
    Strategy(12, "weak balance", ["balance < -500", "n_items >= 6"], "or", "reject", 2),
    Strategy(13, "unknown", ["nowhere > 1"], "and", "reject", 3),
    Strategy(14, "known segment", ["segment != FURNITURE"], "and", "approve", 4),
    Strategy(15, "small orders", ["qty <= 250"], "and", "approve", 5),
    Strategy(16, "urgent", ["priority == 1-URGENT", "balance < 3000"], "and", "reject", 6),
]
EXPERIMENT = [
    Strategy(22, "weak balance", ["balance < 0"], "and", "reject", 2),
    Strategy(21, "high amount", ["amount > 400000"], "and", "reject", 1),
]
LEAVING = """leaving AS (SELECT *, CASE WHEN amount > 450000 THEN 1 WHEN balance < -500 OR COALESCE(n_items >= 6, false) THEN 2
    WHEN NOT segment <> 'FURNITURE' THEN 4 WHEN NOT COALESCE(qty <= 250, false) THEN 5
    WHEN priority = '1-URGENT' AND balance < 3000 THEN 6 ELSE 0 END AS node,
  CASE WHEN amount > 400000 THEN 1 WHEN balance < 0 THEN 2 ELSE 0 END AS other FROM app)"""
DECISION = "CASE node WHEN 1 THEN -1 WHEN 2 THEN -1 WHEN 4 THEN 0 WHEN 6 THEN -1 ELSE 1 END"


@query("flow_decisions", on_app(
    f"SELECT app_id, node AS leaving_node, {DECISION} AS decision, {DECISION} = 1 AS passed FROM leaving", LEAVING))
def flow_decisions(spark, folder):
    app = applications(spark, folder, COLUMNS)
    return strategy.decide(app, BASELINE).select("app_id", "leaving_node", "decision", "passed")


def node_sql(column, listing):
    return f"""(SELECT n.node, n.id, n.name, n.kind AS rule_type, i AS node_input_count, c AS intercept_count, i - c AS pass_count,
    round(CASE WHEN i > 0 THEN c / i ELSE 0 END, 4) AS node_intercept_rate,
    CASE WHEN n.name = 'unknown' THEN 1.0 ELSE round(CASE WHEN i > 0 THEN (i - c) / i ELSE 0 END, 4) END AS node_pass_rate,
    round(c / t, 4) AS global_intercept_rate, round((i - c) / t, 4) AS global_pass_rate
  FROM (SELECT l.node, l.id, l.name, l.kind, COUNT(*) FILTER (leaving.{column} = l.node) AS c,
      COUNT(*) FILTER (leaving.{column} >= l.node OR leaving.{column} = 0) AS i, COUNT(*) AS t
    FROM leaving, (VALUES {listing}) l(node, id, name, kind) GROUP BY ALL) n)"""


BASE_NODES = ("(1, 11::BIGINT, 'high amount', 'reject'), (2, 12, 'weak balance', 'reject'), (3, 13, 'unknown', 'reject'), "
              "(4, 14, 'known segment', 'approve'), (5, 15, 'small orders', 'approve'), (6, 16, 'urgent', 'reject')")
NEW_NODES = "(1, 21::BIGINT, 'high amount', 'reject'), (2, 22, 'weak balance', 'reject')"


@query("flow_nodes", on_app("SELECT * FROM " + node_sql("node", BASE_NODES), LEAVING))
def flow_nodes(spark, folder):
    return strategy.flow_nodes(applications(spark, folder, COLUMNS), BASELINE)


@query("flow_summary", on_app(
    f"SELECT COUNT(*) AS total_count, COUNT(*) FILTER (d = 1) AS pass_count, COUNT(*) FILTER (d < 1) AS hit_count, "
    f"round(COUNT(*) FILTER (d = 1) / COUNT(*), 4) AS approval_rate FROM (SELECT {DECISION} AS d FROM leaving)", LEAVING))
def flow_summary(spark, folder):
    return strategy.flow_summary(applications(spark, folder, COLUMNS), BASELINE)


@query("flow_funnel", on_app(
    "SELECT node AS step, name, global_pass_rate AS survival FROM " + node_sql("node", BASE_NODES)
    + " UNION ALL SELECT 0, 'all', 1.0", LEAVING))
def flow_funnel(spark, folder):
    return strategy.flow_funnel(applications(spark, folder, COLUMNS), BASELINE)


@query("flow_comparison", on_app(f"""
SELECT t AS total_count, b AS baseline_pass_count, t - b AS baseline_hit_count, round(b / t, 4) AS baseline_approval_rate,
  e AS experiment_pass_count, t - e AS experiment_hit_count, round(e / t, 4) AS experiment_approval_rate,
  round(round(e / t, 4) - round(b / t, 4), 4) AS approval_rate_delta, b - e AS hit_count_delta, e - b AS pass_count_delta
FROM (SELECT COUNT(*) AS t, COUNT(*) FILTER ({DECISION} = 1) AS b, COUNT(*) FILTER (other = 0) AS e FROM leaving)""", LEAVING))
def flow_comparison(spark, folder):
    return strategy.compare_flows(applications(spark, folder, COLUMNS), BASELINE, EXPERIMENT)


@query("flow_comparison_nodes", on_app(
    "SELECT 'baseline' AS flow, * FROM " + node_sql("node", BASE_NODES) + " UNION ALL SELECT 'experiment', * FROM "
    + node_sql("other", NEW_NODES), LEAVING))
def flow_comparison_nodes(spark, folder):
    return strategy.compare_nodes(applications(spark, folder, COLUMNS), BASELINE, EXPERIMENT)


# ---------------------------------------------------------------- swap

OLD_RULES = ["balance < 1500"]
NEW_RULES = ["score < 592"]
SWAP = ("sw AS (SELECT CASE WHEN balance < 1500 THEN NULL ELSE label END AS y, score, balance < 1500 AS o, score < 592 AS n FROM scored)")
SWAP_BINS = (
    SCORED, SWAP,
    "qe AS (SELECT list_sort(list_distinct(quantile_cont(score, [0, 1/6::DOUBLE, 2/6::DOUBLE, 3/6::DOUBLE, 4/6::DOUBLE, 5/6::DOUBLE, 1]))) AS e "
    "FROM sw WHERE y IS NOT NULL)",
    "sb AS (SELECT sw.*, 1 + len(list_filter(e, lambda c: c <= score)) AS bin FROM sw, qe)",
    "base AS (SELECT avg(y) AS rate FROM sw)",
    "inf AS (SELECT b AS bin, COUNT(y) AS pass_count, CAST(COALESCE(SUM(y), 0) AS BIGINT) AS pass_bad, SUM(y) / nullif(COUNT(y), 0) AS badrate, "
    "COUNT(*) FILTER (bin IS NOT NULL AND y IS NULL AND o AND NOT n) AS reject_cnt FROM (SELECT unnest(range(1, len(e) + 2)) AS b FROM qe) "
    "LEFT JOIN sb ON bin = b GROUP BY b)")


def swap_input(spark, folder):
    app = scored(spark, folder, ["balance", "label"])
    labelled = F.when(F.col("balance") < 1500, None).otherwise(F.col("label"))
    return swap.swap_cells(app.withColumn("label", labelled), OLD_RULES, NEW_RULES)


@query("swap_decision_matrix", on_app(
    "SELECT COUNT(*) FILTER (NOT o AND NOT n) AS both_pass, COUNT(*) FILTER (NOT o AND n) AS swap_out, "
    "COUNT(*) FILTER (o AND NOT n) AS swap_in, COUNT(*) FILTER (o AND n) AS both_reject, COUNT(*) AS total FROM sw", SCORED, SWAP))
def swap_decision_matrix(spark, folder):
    return swap.decision_matrix(swap_input(spark, folder)[0])


@query("swap_bad_matrix", on_app(
    "SELECT CAST(SUM(y) FILTER (NOT o AND NOT n) AS BIGINT) AS both_pass_bad, CAST(SUM(y) FILTER (NOT o AND n) AS BIGINT) AS swap_out_bad, "
    "CAST(SUM(y) FILTER (o AND NOT n) AS BIGINT) AS swap_in_bad, CAST(SUM(y) FILTER (o AND n) AS BIGINT) AS both_reject_bad FROM sw",
    SCORED, SWAP))
def swap_bad_matrix(spark, folder):
    return swap.bad_matrix(swap_input(spark, folder)[0])


@query("swap_inference", on_app(
    "SELECT CAST(bin AS INT) AS bin, pass_count, pass_bad, round(badrate, 4) AS badrate, round(badrate / rate, 4) AS lift, reject_cnt, "
    "round(reject_cnt * badrate, 2) AS est_bad_cnt FROM inf, base", *SWAP_BINS))
def swap_inference(spark, folder):
    cells, edges = swap_input(spark, folder)
    return swap.inference_table(cells, edges).drop("low", "high", "bin_range")


@query("swap_summary", on_app("""
SELECT total, both_pass, swap_out_count, old_reject_new_pass, both_reject, swap_in_count, round(est, 1) AS swap_in_est_bad,
  CASE WHEN swap_in_count > 0 THEN round(est / swap_in_count, 4) ELSE 0 END AS swap_in_est_badrate, swap_out_bad, round(swap_out_bad / so, 4) AS swap_out_badrate,
  round(bpb / both_pass, 4) AS both_pass_cell_badrate, round(swap_out_bad / swap_out_count, 4) AS swap_out_cell_badrate,
  both_pass + swap_out_count AS old_pass_count, both_pass + old_reject_new_pass AS new_pass_count,
  round((both_pass + swap_out_count) / total, 4) AS old_pass_rate, round((both_pass + old_reject_new_pass) / total, 4) AS new_pass_rate,
  round((both_pass + old_reject_new_pass) / total - (both_pass + swap_out_count) / total, 4) AS pass_rate_delta,
  round(lob / lo, 4) AS old_badrate, round((lnb + est) / (ln + swap_in_count), 4) AS new_badrate,
  round((lnb + est) / (ln + swap_in_count) - lob / lo, 4) AS badrate_delta, round(rate, 4) AS overall_badrate
FROM (SELECT COUNT(*) AS total, COUNT(*) FILTER (NOT o AND NOT n) AS both_pass, COUNT(*) FILTER (NOT o AND n) AS swap_out_count,
    COUNT(*) FILTER (o AND NOT n) AS old_reject_new_pass, COUNT(*) FILTER (o AND n) AS both_reject,
    COUNT(*) FILTER (y IS NULL AND o AND NOT n) AS swap_in_count, COUNT(y) FILTER (NOT o) AS lo, SUM(y) FILTER (NOT o) AS lob,
    COUNT(y) FILTER (NOT n) AS ln, SUM(y) FILTER (NOT n) AS lnb, COUNT(y) FILTER (NOT o AND n) AS so,
    CAST(SUM(y) FILTER (NOT o AND n) AS BIGINT) AS swap_out_bad, SUM(y) FILTER (NOT o AND NOT n) AS bpb FROM sw),
  (SELECT SUM(reject_cnt * badrate) AS est FROM inf), base""", *SWAP_BINS))
def swap_summary(spark, folder):
    return swap.swap_summary(*swap_input(spark, folder))
