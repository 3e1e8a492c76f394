import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendgauge.functions.predicates import Rule, Strategy, compile_rules, parse_rules, text_columns_with_numbers
from lendgauge.operators import mining, monitor, strategy, swap


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, float(i), "n/a" if i % 4 == 0 else str(i), None if i % 5 == 0 else "x" if i % 2 else "y", i % 3 == 0 and 1 or 0)
            for i in range(1, 61)]
    return spark.createDataFrame(rows, "id int, a double, t string, s string, label int").cache()


def ids(df, condition):
    return {r["id"] for r in df.where(condition).select("id").collect()}


def test_text_rules_and_alias():
    assert parse_rules("Score < 450 and b != x", score_field="_model_result_3") == [
        Rule("_model_result_3", "<", 450.0), Rule("b", "!=", "x")]
    with pytest.raises(ValueError):
        parse_rules("no condition")


def test_number_or_text_comparison_and_nulls(people):
    assert text_columns_with_numbers(people, [Rule("t", ">", 50), Rule("s", ">", 50)]) == {"t"}
    assert ids(people, compile_rules(people, ["t > 50"])) == {i for i in range(51, 61) if i % 4}
    # No number in s: 5 is compared as text, and a missing value satisfies only !=.
    assert ids(people, compile_rules(people, ["s > 5"])) == {i for i in range(1, 61) if i % 5}
    assert ids(people, compile_rules(people, ["s != x"])) == {i for i in range(1, 61) if i % 5 == 0 or i % 2 == 0}


def test_unknown_fields_skipped_or_false(people):
    rules = ["a > 10", "nowhere > 1"]
    assert len(ids(people, compile_rules(people, rules))) == 50
    assert ids(people, compile_rules(people, rules, missing="false")) == set()
    assert compile_rules(people, ["nowhere > 1"]) is None
    with pytest.raises(ValueError):
        strategy.analyse_rules(people, ["nowhere > 1"])
    with pytest.raises(ValueError):
        Strategy(1, "s", [], "and", "review")


def flow_by_rows(people, strategies):
    """Row by row: walk the nodes, keep the last decision."""
    counts, passed = {}, 0
    approve = any(s.rule_type == "approve" for s in strategies)
    for r in people.collect():
        decision = 0
        for n, s in enumerate(strategies, 1):
            op, at = s.rules[0].op, s.rules[0].val
            hit = r["a"] > at if op == ">" else r["a"] <= at
            cut = hit if s.rule_type == "reject" else not hit
            counts.setdefault(n, [0, 0])
            counts[n][0] += 1
            if s.rule_type == "reject" and hit:
                decision = -1
            if s.rule_type == "approve" and hit:
                decision = 1
            if cut:
                counts[n][1] += 1
                break
        passed += decision == (1 if approve else 0)
    return counts, passed


@pytest.mark.parametrize("kinds", [("reject", "reject"), ("approve", "approve"), ("approve", "reject"), ("reject", "approve", "approve")])
def test_flow_matches_row_walk(people, kinds):
    limits = [("a > 50.0", "a <= 40.0"), ("a > 30.0", "a <= 20.0"), ("a > 55.0", "a <= 10.0")]
    strategies = [Strategy(n, k, [limits[n][k == "approve"]], rule_type=k, priority=n) for n, k in enumerate(kinds)]
    counts, passed = flow_by_rows(people, strategies)
    nodes = {r["node"]: r for r in strategy.flow_nodes(people, strategies).collect()}
    for n, (reached, cut) in counts.items():
        assert (nodes[n]["node_input_count"], nodes[n]["intercept_count"]) == (reached, cut)
    one = strategy.flow_summary(people, strategies).first()
    assert one["pass_count"] == passed and one["pass_count"] + one["hit_count"] == one["total_count"] == 60
    assert strategy.decide(people, strategies).where("passed").count() == passed


def test_flow_without_valid_rules(people):
    nodes = strategy.flow_nodes(people, [Strategy(1, "none", ["nowhere > 1"])]).first()
    assert nodes["pass_count"] == 60 and nodes["node_pass_rate"] == 1.0
    assert strategy.flow_summary(people, []).first()["pass_count"] == 60
    # An approve strategy without a rule passes its node, yet nobody is approved in the end.
    assert strategy.flow_summary(people, [Strategy(1, "none", ["nowhere > 1"], rule_type="approve")]).first()["pass_count"] == 0


def test_comparison_and_log_row(people):
    old, new = [Strategy(1, "o", ["a > 50"])], [Strategy(2, "n", ["a > 40"])]
    one = strategy.compare_flows(people, old, new).first()
    assert (one["hit_count_delta"], one["pass_count_delta"]) == (10, -10)
    logged = monitor.monitor_comparison(people, old, new, batch_name="b").first()
    assert {n["flow"] for n in logged["nodes"]} == {"baseline", "experiment"} and logged["batch_name"] == "b"


def test_swap_by_hand(spark):
    # old rejects x < 5 (no label), new rejects y < 3.
    rows = [(x, float(y), None if x < 5 else int(y < 4)) for x in range(10) for y in range(6)]
    df = spark.createDataFrame(rows, "x int, y double, label int")
    cells, edges = swap.swap_cells(df, ["x < 5"], ["y < 3"], score="y")
    one = swap.swap_summary(cells, edges).first()
    assert (one["both_pass"], one["swap_out_count"], one["old_reject_new_pass"], one["both_reject"]) == (15, 15, 15, 15)
    # Swapped-in rows: y in 3, 4, 5, five each; labelled bad rates 1, 0, 0.
    assert one["swap_in_count"] == 15 and one["swap_in_est_bad"] == 5.0
    assert one["swap_out_badrate"] == 1.0 and one["new_badrate"] == pytest.approx((5 + 5) / 30, abs=1e-4)
    table = swap.inference_table(cells, edges).collect()
    assert sum(r["pass_count"] for r in table) == 30 and table[0]["pass_count"] == 0 and table[0]["badrate"] is None
    with pytest.raises(ValueError):
        swap.swap_cells(df, ["x < 5"], ["z < 3"])
    assert swap.decision_matrix(swap.swap_cells(df, [], ["y < 3"])[0]).first()["swap_out"] == 30


# ---------------------------------------------------------------- rule sets

RULES = ["a > 50.0", "a > 55.0", "a <= 10.0 and b > 5.0", "b > 8.0", "a > 20.0 and b <= 1.0", "a <= 30.0"]


@pytest.fixture(scope="module")
def mined(spark):
    generator = np.random.default_rng(8)
    rows = [(i, float(generator.integers(0, 61)), float(generator.integers(0, 11)), int(generator.random() < 0.3),
             "train" if i % 3 else "test") for i in range(400)]
    return spark.createDataFrame(rows, "id int, a double, b double, label int, target_group string").cache()


def meets(rule, r):
    return all(r[x.field] > x.val if x.op == ">" else r[x.field] <= x.val for x in parse_rules(rule))


def greedy(rows, rules, policy):
    base, left, kept = sum(r["label"] for r in rows) / len(rows), list(rows), []
    for n, rule in enumerate(rules):
        new = [r for r in left if meets(rule, r)]
        bads = sum(r["label"] for r in new)
        if (policy == 1 and not new) or (policy == 2 and not bads) or (policy == 3 and (bads / len(new) if new else 0) < base):
            continue
        kept.append((n, len(new), bads))
        left = [r for r in left if not meets(rule, r)]
    return kept


@pytest.mark.parametrize("policy,driver_patterns", [(0, 9999), (1, 9999), (2, 9999), (3, 9999), (3, 0)])
def test_greedy_rule_set(mined, policy, driver_patterns):
    performance = mining.rule_performance(mined, RULES)
    found = mining.rule_set(mined, performance, policy, rules=RULES, driver_patterns=driver_patterns).collect()
    expected = greedy(mined.collect(), RULES, policy)
    assert [(RULES.index(r["rule"]), r["new_total"], r["new_bad"]) for r in found] == expected
    assert found[-1]["cum_total"] == sum(e[1] for e in expected)


def test_rule_performance_and_capture(mined):
    rows = mined.collect()
    measured = {r["rule"]: r for r in mining.rule_performance(mined, RULES).collect()}
    for rule in RULES:
        hits = [r for r in rows if meets(rule, r)]
        assert measured[rule]["total_all"] == len(hits)
        train = [r for r in hits if r["target_group"] == "train"]
        assert measured[rule]["bad_train"] == sum(r["label"] for r in train)
        a, b = measured[rule]["bad_rate_test"], measured[rule]["bad_rate_train"]
        assert measured[rule]["psi"] == pytest.approx((a - b) * math.log((a or 1e-6) / (b or 1e-6)))
    captured = mining.captured(mined, RULES, keep=["id"])
    assert captured.columns == ["id", "a", "b", "hit_rule"]
    first = {r["id"]: next((x for x in RULES if meets(x, r)), None) for r in rows}
    assert {r["id"]: r["hit_rule"] for r in captured.collect()} == {k: v for k, v in first.items() if v}


def test_extracted_rules_partition_the_rows(app):
    features = ["amount", "balance"]
    model = mining.fit_trees(app, features, kind="dt", min_leaf=20)
    rules = mining.extract_rules(model, features)
    total = sum(r["total_all"] for r in mining.rule_performance(
        app.withColumn("target_group", F.lit("train")), rules).collect())
    assert len(rules) > 2 and total == app.count()


def test_rules_are_measured_in_one_pass(spark):
    """The table of rules doesn't go back to the rows."""
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    df = spark.createDataFrame([(float(i), i % 2, "train" if i % 3 else "test") for i in range(60)], "x double, label int, target_group string")
    rows = mining.rule_performance(df.mapInArrow(passed, df.schema), ["x > 30.0", "x <= 9.0"]).orderBy("rule_id").collect()
    assert [(r["total_all"], r["bad_all"]) for r in rows] == [(29, 15.0), (10, 5.0)]
    assert seen.value == 60
