"""Rules from trees: extraction, performance, greedy rule sets and captured rows."""

import math
import re

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.guards import numeric_columns, ratio
from ..functions.predicates import compile_rules, parse_rules
from . import random_trees
from .split import mining_split

# Fixed value: bad rates of zero are replaced by this in the PSI.
RATE_EPSILON = 1e-6
# Distinct hit patterns that may be walked on the driver.
DRIVER_PATTERNS = 50_000

_BRANCH = re.compile(r"^(?P<indent>\s*)(?P<kind>If|Else) \(feature (?P<n>\d+) (?P<op><=|>) (?P<at>\S+)\)$")


def fit_trees(train: DataFrame, features, label="label", kind="exrf", max_depth=3, n_trees=100, min_leaf=100,
              max_features=0.5, seed=2024, fill_value=-999.0, key=None):
    """Fitted ``dt`` (one tree), ``rf`` (a forest of best splits) or ``exrf`` (extremely randomised trees, a list of them).

    Single trees and forests predict the bad rate: on a 0/1 label the variance ranks splits as Gini does, while
    classification trees would merge neighbouring leaves that predict the same class.
    """
    if kind == "exrf":
        return random_trees.fit(train, features, label, key, n_trees, max_depth, min_leaf, max_features, seed=seed, fill_value=fill_value)
    if kind not in ("dt", "rf"):
        raise ValueError("kind must be dt, rf or exrf")
    named = train.select(
        F.col(label).cast("double").alias("_y"),
        *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(fill_value)).alias(f"_x{n}") for n, c in enumerate(features)])
    rows = VectorAssembler(inputCols=[f"_x{n}" for n in range(len(features))], outputCol="features").transform(
        named.where(F.col("_y").isNotNull())).select("features", "_y")
    common = dict(featuresCol="features", labelCol="_y", maxDepth=max_depth, minInstancesPerNode=min_leaf, seed=seed)
    if kind == "dt":
        return DecisionTreeRegressor(**common).fit(rows)
    return RandomForestRegressor(numTrees=n_trees, featureSubsetStrategy=str(max_features), **common).fit(rows)


def extract_rules(model, features):
    """Every leaf of the trees as a conjunction, thresholds to four digits, repeats dropped."""
    rules = []
    if isinstance(model, list):
        for tree in model:
            rules += [" and ".join(f"{features[f]} {'<=' if left else '>'} {round(float(at), 4)}" for f, left, at in path)
                      for path, _, _ in tree.leaves() if path]
        return list(dict.fromkeys(rules))
    for tree in getattr(model, "trees", [model]):
        path = []
        # The first line names the tree.
        for line in tree.toDebugString.splitlines()[1:]:
            branch = _BRANCH.match(line)
            if branch:
                depth = len(branch["indent"])
                path = [p for p in path if p[0] < depth]
                path.append((depth, f"{features[int(branch['n'])]} {branch['op']} {round(float(branch['at']), 4)}"))
            elif line.strip().startswith("Predict:"):
                if path:
                    rules.append(" and ".join(text for _, text in path))
            elif line.strip():
                raise ValueError(f"a line of a tree that can't be read: {line!r}")
    return list(dict.fromkeys(rules))


def _conditions(df, rules):
    return [compile_rules(df, parse_rules(r)) for r in rules]


def rule_performance(df: DataFrame, rules, label="label", group="target_group") -> DataFrame:
    """One row per rule with train, test and overall figures, PSI of bad rates and lift decay.

    Rows that meet the same rules are counted together, by group, before each pattern is dealt out to its rules.
    """
    rules = list(dict.fromkeys(rules))
    spark = df.sparkSession
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in enumerate(_conditions(df, rules))]))
    patterns = df.groupBy(hits.alias("_hits"), F.col(group).alias("_g")).agg(
        F.count("*").alias("_n"), F.sum(F.col(label).cast("double")).alias("_y"))
    # Rule -1 holds every row: the totals of the groups.
    rows = patterns.select("_g", "_n", "_y", F.explode(F.array_append("_hits", F.lit(-1))).alias("rule_id"))
    counted = rows.groupBy("rule_id").agg(
        *[a.alias(f"{name}_{part}") for part, inside in (
            ("train", F.col("_g") == "train"), ("test", F.col("_g") == "test"), ("all", F.lit(True)))
          for name, a in (("total", F.coalesce(F.sum(F.when(inside, F.col("_n"))), F.lit(0))), ("bad", F.coalesce(F.sum(F.when(inside, F.col("_y"))), F.lit(0.0))))])
    # One row per rule, read once: rows meet hundreds of rules in a pass.
    found = counted.collect()
    counted = spark.createDataFrame(found, counted.schema)
    whole = next((r for r in found if r["rule_id"] == -1), None)
    listed = spark.createDataFrame([(n, r) for n, r in enumerate(rules)], "rule_id int, rule string")
    joined = listed.join(counted, "rule_id", "left").na.fill(0)
    columns = ["rule_id", "rule"]
    result = joined
    for part in ("train", "test", "all"):
        total, bad = (whole[f"total_{part}"], whole[f"bad_{part}"]) if whole else (0, 0.0)
        base = bad / total if total else 0.0
        result = result.withColumns({
            f"good_{part}": F.col(f"total_{part}") - F.col(f"bad_{part}"),
            f"bad_rate_{part}": ratio(f"bad_{part}", f"total_{part}"),
            f"hit_rate_{part}": F.col(f"total_{part}") / F.lit(total) if total else F.lit(0.0)})
        result = result.withColumn(f"lift_{part}", F.col(f"bad_rate_{part}") / F.lit(base) if base > 0 else F.lit(0.0))
        columns += [f"{c}_{part}" for c in ("bad", "good", "total", "bad_rate", "lift", "hit_rate")]
    a, b = F.col("bad_rate_test"), F.col("bad_rate_train")
    shift = (a - b) * F.ln(F.when(a > 0, a).otherwise(RATE_EPSILON) / F.when(b > 0, b).otherwise(RATE_EPSILON))
    return result.withColumns({"psi": shift, "lift_decay": F.col("lift_train") - F.col("lift_test")}).select(
        *columns, "psi", "lift_decay").orderBy(F.desc("bad_rate_train"), "rule_id")


def mining_summary(performance: DataFrame) -> DataFrame:
    return performance.select(
        "rule", F.col("bad_rate_train").alias("train_bad_rate"), F.col("lift_train").alias("train_lift"),
        F.col("hit_rate_train").alias("train_hit_rate"), F.col("lift_test").alias("test_lift"), "psi")


def mine_rules(df: DataFrame, key, label="label", time_col=None, kind="exrf", features=None, **settings) -> DataFrame:
    """Split, fit, extract and measure: the automatic rule search."""
    tagged = mining_split(df, key, time_col)
    hidden = {label, "target_group", time_col, key}
    features = features or [c for c in numeric_columns(df, narrow=True) if c not in hidden]
    if not features:
        raise ValueError("no numeric feature to mine")
    model = fit_trees(tagged.where(F.col("target_group") == "train"), features, label, kind, key=key, **settings)
    return rule_performance(tagged, extract_rules(model, features), label)


# ---------------------------------------------------------------- greedy sets

def first_hit_counts(df: DataFrame, rules, kept, label="label", group="target_group"):
    """[(group, first kept rule met or None, rows, bads)]: one aggregation with one row per rule and group."""
    conditions = _conditions(df, [rules[k] for k in kept])
    steps = [F.when(c, F.lit(k)) for c, k in zip(conditions, kept)]
    first = F.coalesce(*steps) if steps else F.lit(None).cast("int")
    counted = df.select(F.col(group).alias("g"), first.alias("r"), F.col(label).cast("double").alias("_y")).groupBy(
        "g", "r").agg(F.count("*").alias("n"), F.coalesce(F.sum("_y"), F.lit(0.0)).alias("bad"))
    return counted.collect()


def hit_patterns(df: DataFrame, rules, label="label") -> DataFrame:
    """(hits, n, bad): rows that meet the same rules, as sorted rule positions, counted together."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in enumerate(_conditions(df, rules))]))
    return df.select(hits.alias("hits"), F.col(label).cast("double").alias("_y")).groupBy("hits").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("_y"), F.lit(0.0)).alias("bad"))


def choose_by_rate(patterns: DataFrame, n_rules, driver_patterns=DRIVER_PATTERNS):
    """Positions kept when every rule, in order, must meet rows not met by a kept one before whose bad
    rate is not below that of all rows.

    Few patterns are walked on the driver; many stay in Spark, with one aggregation per dropped rule.
    """
    whole = patterns.agg(F.count("*").alias("p"), F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    base = whole["bad"] / whole["n"] if whole["n"] else 0.0
    if whole["p"] <= driver_patterns:
        return _walk(patterns.collect(), list(range(n_rules)), base)
    kept, at = list(range(n_rules)), 0
    while at < len(kept):
        # Rules before ``at`` are settled; the first one that fails now is dropped for good.
        met = _first_hits(patterns, kept)
        while at < len(kept):
            n, bad = met.get(kept[at], (0, 0.0))
            if (bad / n if n else 0.0) < base:
                kept.pop(at)
                break
            at += 1
    return kept


def choose_rules(df: DataFrame, rules, policy=1, label="label", group="target_group", driver_patterns=DRIVER_PATTERNS):
    """(kept positions, their first-hit counts) when walking the rules in order.

    policy 0 keeps all; 1 asks for new rows; 2 for new bads; 3 for a bad rate of the new rows not
    below that of all rows. Under 1 and 2 a dropped rule frees no rows (1) or no bads (2), so later
    rules are judged alike and one pass decides all.
    """
    every = list(range(len(rules)))
    if policy == 3:
        patterns = hit_patterns(df, rules, label).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            kept = choose_by_rate(patterns, len(rules), driver_patterns)
        finally:
            patterns.unpersist()
        return kept, first_hit_counts(df, rules, kept, label, group)
    if policy not in (0, 1, 2):
        raise ValueError("policy must be 0, 1, 2 or 3")
    counted = first_hit_counts(df, rules, every, label, group)
    if policy == 0:
        return every, counted
    measure = "n" if policy == 1 else "bad"
    new = {k: sum(r[measure] for r in counted if r["r"] == k) for k in every}
    kept = [k for k in every if new[k] > 0]
    return kept, counted if policy == 1 else first_hit_counts(df, rules, kept, label, group)


def _first_hits(patterns, kept):
    """{rule: (rows, bads)} by the first kept rule each row meets."""
    first = F.array_min(F.array_intersect("hits", F.array(*[F.lit(k) for k in kept])))
    counted = patterns.select(first.alias("r"), "n", "bad").where(F.col("r").isNotNull()).groupBy("r").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    return {r["r"]: (r["n"], r["bad"]) for r in counted.collect()}


def _walk(rows, order, base):
    left, kept = [(set(r["hits"]), r["n"], r["bad"]) for r in rows], []
    for rule in order:
        new = [p for p in left if rule in p[0]]
        n, bad = sum(p[1] for p in new), sum(p[2] for p in new)
        if (bad / n if n else 0.0) >= base:
            kept.append(rule)
            left = [p for p in left if rule not in p[0]]
    return kept


def rule_set(df: DataFrame, performance: DataFrame, policy=1, sort_by="test", max_decay=None, max_psi=None, rules=None,
             label="label", group="target_group", driver_patterns=DRIVER_PATTERNS) -> DataFrame:
    """Ordered rule set with new and cumulative figures overall, cumulative hit rates on train and test, and
    their PSI.

    Rules come from the measured ones (cut by lift decay and PSI, sorted by a part's bad rate) or from
    an explicit list. The measured rules number at most a few hundred.
    """
    table = performance
    if rules is None:
        if max_decay is not None:
            table = table.where(F.col("lift_decay") <= max_decay)
        if max_psi is not None:
            table = table.where(F.col("psi") <= max_psi)
        if sort_by not in ("train", "test", "all"):
            raise ValueError("sort_by must be train, test or all")
        rules = [r["rule"] for r in table.orderBy(F.desc(f"bad_rate_{sort_by}"), "rule_id").select("rule").collect()]
    decay = {r["rule"]: r["lift_decay"] for r in performance.select("rule", "lift_decay").collect()}
    schema = ("position int, rule string, lift_decay double, new_total bigint, new_bad bigint, new_good bigint, cum_total bigint, "
              "cum_bad bigint, cum_good bigint, cum_bad_rate double, cum_hit_rate double, cum_lift double, rest_bad_rate double, "
              "rest_lift double, train_cum_hit_rate double, test_cum_hit_rate double, psi double")
    if not rules:
        return df.sparkSession.createDataFrame([], schema)
    kept, counted = choose_rules(df, rules, policy, label, group, driver_patterns)
    # From here on one number per kept rule and group.
    def figures(part):
        chosen = [r for r in counted if part is None or r["g"] == part]
        met = {}
        for r in chosen:
            n, bad = met.get(r["r"], (0, 0.0))
            met[r["r"]] = (n + r["n"], bad + r["bad"])
        return met, sum(r["n"] for r in chosen), sum(r["bad"] for r in chosen)

    overall, total, bads = figures(None)
    (train, train_n, _), (test, test_n, _) = figures("train"), figures("test")
    base = bads / total if total else 0.0
    rows, cum, cum_bad, cum_train, cum_test = [], 0, 0.0, 0, 0
    for position, k in enumerate(kept, 1):
        n, bad = overall.get(k, (0, 0.0))
        cum, cum_bad = cum + n, cum_bad + bad
        cum_train, cum_test = cum_train + train.get(k, (0, 0))[0], cum_test + test.get(k, (0, 0))[0]
        rate = cum_bad / cum if cum else 0.0
        rest = (bads - cum_bad) / (total - cum) if total > cum else 0.0
        on_train, on_test = cum_train / train_n if train_n else 0.0, cum_test / test_n if test_n else 0.0
        psi = 0.0 if on_train == 0 else ((on_test - on_train) * math.log(on_test / on_train) if on_test > 0 else None)
        rows.append((position, rules[k], decay.get(rules[k]), n, int(bad), int(n - bad), cum, int(cum_bad), int(cum - cum_bad),
                     rate, cum / total if total else 0.0, rate / base if base else 0.0, rest, rest / base if base else 0.0,
                     on_train, on_test, psi))
    return df.sparkSession.createDataFrame(rows, schema)


def captured(df: DataFrame, rules, keep=()) -> DataFrame:
    """Rows met by any rule with the first rule that met them and the columns the rules use."""
    conditions = _conditions(df, rules)
    used = list(dict.fromkeys(r.field for text in rules for r in parse_rules(text)))
    first = F.coalesce(*[F.when(c, F.lit(text)) for c, text in zip(conditions, rules)])
    return df.withColumn("hit_rule", first).where(F.col("hit_rule").isNotNull()).select(
        *[c for c in keep if c not in used], *used, "hit_rule")


__all__ = ["captured", "choose_by_rate", "choose_rules", "extract_rules", "fit_trees", "hit_patterns", "mine_rules", "mining_summary",
           "rule_performance", "rule_set"]
