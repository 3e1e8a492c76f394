"""Queries on bins: edges, WOE tables and stability."""


from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from ...operators import binning, psi, woe
from ..loanbook import NUMERIC_FEATURES, kept_applications
from .registry import (binned_part, cuts_part, long_part, on_app, query, r6, rounded, woe_columns, woe_part, woe_select)

FEATURES = NUMERIC_FEATURES
SETS = ("train", "valid", "oot")


def train(spark, folder, columns):
    return kept_applications(spark, folder, [*columns, "target"]).where(F.col("target") == "train")


def edges_frame(spark, edges) -> DataFrame:
    """(feature, position, edge) of the finite edges."""
    rows = [(f, n, float(e)) for f, es in edges.items() for n, e in enumerate(x for x in es if abs(x) != float("inf"))]
    return rounded(spark.createDataFrame(rows, "feature string, position int, edge double"))



# ---------------------------------------------------------------- edges and assignment

@query("equal_frequency_edges", on_app(
    "SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY edge) - 1 AS INT) AS position, round(edge, 6) AS edge "
    "FROM (SELECT DISTINCT feature, unnest(quantile_cont(value, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1])) AS edge "
    "FROM long GROUP BY feature)", long_part()))
def equal_frequency_edges(spark, folder):
    return edges_frame(spark, binning.equal_frequency_edges(kept_applications(spark, folder, FEATURES), FEATURES)[()])


@query("equal_width_edges", on_app(
    "SELECT feature, CAST(i AS INT) AS position, round(CASE WHEN i = 10 THEN hi ELSE i * ((hi - lo) / 10) + lo END, 6) AS edge "
    "FROM (SELECT feature, min(value) AS lo, max(value) AS hi FROM long GROUP BY feature), range(11) t(i)", long_part()))
def equal_width_edges(spark, folder):
    return edges_frame(spark, binning.equal_width_edges(kept_applications(spark, folder, FEATURES), FEATURES, 10))


def stump(minimum):
    """Named parts: the best Gini cut per feature with at least ``minimum`` of the rows on both sides."""
    return f"""v AS (SELECT feature, value, CAST(COUNT(*) FILTER (label = 0) AS DOUBLE) AS g,
           CAST(COUNT(*) FILTER (label = 1) AS DOUBLE) AS b FROM long WHERE value IS NOT NULL GROUP BY feature, value),
c AS (SELECT feature, value, lead(value) OVER o AS following, SUM(g) OVER o AS lg, SUM(b) OVER o AS lb,
           SUM(g) OVER p AS tg, SUM(b) OVER p AS tb FROM v
      WINDOW p AS (PARTITION BY feature), o AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, (lg * lg + lb * lb) / (lg + lb) + ((tg - lg) * (tg - lg) + (tb - lb) * (tb - lb)) / (tg + tb - lg - lb) AS gain
      FROM c WHERE following IS NOT NULL AND lg + lb >= ceil({minimum}::DOUBLE * (tg + tb))
        AND tg + tb - lg - lb >= ceil({minimum}::DOUBLE * (tg + tb)))"""


@query("tree_stump_edges", on_app(
    "SELECT feature, 0 AS position, round((value + following) / 2, 6) AS edge FROM s "
    "QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, value) = 1", long_part(), stump(0.05)))
def tree_stump_edges(spark, folder):
    app = kept_applications(spark, folder, [*FEATURES, "label"])
    return edges_frame(spark, binning.tree_edges(app, FEATURES, "label", max_leaf_nodes=2, min_samples_leaf=0.05))


def tree_parts(leaves, minimum, where="true"):
    """Named parts of a best-first Gini tree per feature; ``tree_cuts`` has its cuts."""
    parts = [f"""v0 AS (SELECT feature, value, CAST(COUNT(*) FILTER (label = 0) AS DOUBLE) AS g, CAST(COUNT(*) FILTER (label = 1) AS DOUBLE) AS b, 0 AS leaf
  FROM long WHERE value IS NOT NULL AND {where} GROUP BY feature, value)""",
             f"floors AS (SELECT feature, greatest(ceil({minimum}::DOUBLE * SUM(g + b)), 1) AS floor FROM v0 GROUP BY feature)"]
    for k in range(leaves - 1):
        parts += [
            f"""c{k} AS (SELECT v.*, f.floor, lead(value) OVER o AS following, SUM(g) OVER o AS lg, SUM(b) OVER o AS lb, SUM(g) OVER p AS tg, SUM(b) OVER p AS tb
  FROM v{k} v JOIN floors f ON v.feature = f.feature
  WINDOW p AS (PARTITION BY v.feature, leaf), o AS (PARTITION BY v.feature, leaf ORDER BY value ROWS UNBOUNDED PRECEDING))""",
            f"""s{k} AS (SELECT *, (lg * lg + lb * lb) / (lg + lb) + ((tg - lg) * (tg - lg) + (tb - lb) * (tb - lb)) / (tg + tb - lg - lb)
    - (tg * tg + tb * tb) / (tg + tb) AS gain FROM c{k}
  WHERE following IS NOT NULL AND lg + lb >= floor AND tg + tb - lg - lb >= floor AND tg > 0 AND tb > 0
  QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, value) = 1)""",
            f"""v{k + 1} AS (SELECT v.feature, v.value, v.g, v.b, CASE WHEN v.leaf = s.leaf AND v.value > s.value THEN {k + 1} ELSE v.leaf END AS leaf
  FROM v{k} v LEFT JOIN s{k} s ON v.feature = s.feature)"""]
    found = " UNION ALL ".join(f"SELECT feature, (value + following) / 2 AS cut FROM s{k}" for k in range(leaves - 1))
    return *parts, f"tree_cuts AS ({found})"


@query("tree_edges", on_app(
    "SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY cut) - 1 AS INT) AS position, round(cut, 6) AS edge FROM tree_cuts",
    long_part(), *tree_parts(10, 0.02, "target = 'train' AND label IN (0, 1)")))
def tree_edges(spark, folder):
    app = train(spark, folder, [*FEATURES, "label"])
    return edges_frame(spark, binning.tree_edges(app, FEATURES, "label", 10, 0.02))


def chi_parts(bins, where="true"):
    """Named parts: ``merged``, per feature the right edges of the intervals that are left, joined pair by pair from all distinct values.

    Neighbours of one bad rate come first; they are runs of the sorted values.
    """
    side = "(g[i] + b[i]) * (g[i + 1] + b[i + 1]) * (g[i] + g[i + 1]) * (b[i] + b[i + 1])"
    cost = (f"CASE WHEN {side} = 0 THEN 0 ELSE (g[i] + b[i] + g[i + 1] + b[i + 1]) * power(g[i] * b[i + 1] - g[i + 1] * b[i], 2) / ({side}) END")
    return (
        f"cv AS (SELECT feature, value, CAST(COUNT(*) FILTER (label = 0) AS DOUBLE) AS g, CAST(COUNT(*) FILTER (label = 1) AS DOUBLE) AS b "
        f"FROM long WHERE value IS NOT NULL AND label IN (0, 1) AND {where} GROUP BY feature, value)",
        "cr AS (SELECT *, SUM(CASE WHEN g * pb = pg * b THEN 0 ELSE 1 END) OVER (PARTITION BY feature ORDER BY value) AS run FROM (SELECT *, "
        "lag(g) OVER o AS pg, lag(b) OVER o AS pb FROM cv WINDOW o AS (PARTITION BY feature ORDER BY value)))",
        "cs AS (SELECT feature, max(value) AS value, SUM(g) AS g, SUM(b) AS b FROM cr GROUP BY feature, run)",
        f"""merging AS (
  SELECT feature, list(value ORDER BY value) AS e, list(g ORDER BY value) AS g, list(b ORDER BY value) AS b FROM cs GROUP BY feature
  UNION ALL
  SELECT feature, list_concat(e[:k - 1], e[k + 1:]), list_concat(g[:k - 1], [g[k] + g[k + 1]], g[k + 2:]), list_concat(b[:k - 1], [b[k] + b[k + 1]], b[k + 2:])
  FROM (SELECT *, list_position(costs, list_min(costs)) AS k FROM (
    SELECT *, list_transform(range(1, len(e)), lambda i: {cost}) AS costs FROM merging WHERE len(e) > {bins})))""",
        f"merged AS (SELECT feature, e FROM merging WHERE len(e) <= {bins})")


def recursive(statement):
    return statement.replace("WITH ", "WITH RECURSIVE ", 1)


@query("chi_merge_edges", recursive(on_app(
    "SELECT feature, CAST(i - 1 AS INT) AS position, round(e[i], 6) AS edge FROM (SELECT feature, e, unnest(range(1, len(e))) AS i FROM merged)",
    long_part(), *chi_parts(6, "target = 'train'"))))
def chi_merge_edges(spark, folder):
    app = train(spark, folder, [*FEATURES, "label"])
    return edges_frame(spark, binning.chi_merge_edges(app, FEATURES, "label", 6))


@query("bins_right_closed", on_app(
    "SELECT feature, CAST(bin AS INT) AS bin, COUNT(*) AS n FROM binned GROUP BY feature, bin",
    long_part(), cuts_part(), binned_part()))
def bins_right_closed(spark, folder):
    app = kept_applications(spark, folder, [*FEATURES, "target"])
    cuts = binning.equal_frequency_cuts(app.where(F.col("target") == "train"), FEATURES)
    counted = binning.bin_counts(app, cuts, None)
    return counted.select("feature", "bin", F.col("total").alias("n"))


@query("bins_assigned", on_app(
    "SELECT app_id, " + ", ".join(f"max(CASE WHEN feature = '{f}' THEN CAST(bin AS INT) END) AS {f}_bin" for f in FEATURES)
    + " FROM binned GROUP BY app_id", long_part(), cuts_part(), binned_part()))
def bins_assigned(spark, folder):
    app = kept_applications(spark, folder, ["app_id", *FEATURES, "target"])
    cuts = binning.equal_frequency_cuts(app.where(F.col("target") == "train"), FEATURES)
    return binning.assign_bins(app, cuts).select("app_id", *[f"{f}_bin" for f in FEATURES])


WIDTH_PARTS = (
    long_part(),
    "ends AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM long GROUP BY feature)",
    "edges AS (SELECT feature, lo, hi, list_transform(range(11), lambda i: CASE WHEN i = 10 THEN hi "
    "ELSE i * ((hi - lo) / 10) + lo END) AS e FROM ends)")


@query("bins_left_closed", on_app(
    "SELECT feature, CAST(least(len(list_filter(e, lambda c: c <= value)), 10) AS INT) AS bin, COUNT(*) AS n "
    "FROM long JOIN edges USING (feature) WHERE value IS NOT NULL GROUP BY ALL", *WIDTH_PARTS))
def bins_left_closed(spark, folder):
    app = kept_applications(spark, folder, FEATURES)
    edges = binning.equal_width_edges(app, FEATURES, 10)
    counted = binning.bin_counts(app, edges, None, closed="left_highest", missing=None)
    return counted.select("feature", "bin", F.col("total").alias("n"))


@query("bins_lowest_included", on_app(
    "SELECT feature, CAST(greatest(len(list_filter(e, lambda c: c < value)), 1) AS INT) AS bin, COUNT(*) AS n "
    "FROM long JOIN edges USING (feature) WHERE value IS NOT NULL GROUP BY ALL", *WIDTH_PARTS))
def bins_lowest_included(spark, folder):
    app = kept_applications(spark, folder, FEATURES)
    edges = binning.equal_width_edges(app, FEATURES, 10)
    counted = binning.bin_counts(app, edges, None, closed="right_lowest", missing=None)
    return counted.select("feature", "bin", F.col("total").alias("n"))


@query("bin_labels_ordered", on_app(
    "SELECT feature, CAST(bin AS INT) AS bin, bin > len(cuts) + 1 AS is_missing, round(CASE WHEN bin BETWEEN 2 AND len(cuts) + 1 "
    "THEN list_sort(cuts)[bin - 1] END, 4) AS low, COUNT(*) AS n FROM binned JOIN cuts USING (feature) GROUP BY ALL",
    long_part(), cuts_part(), binned_part()))
def bin_labels_ordered(spark, folder):
    app = kept_applications(spark, folder, [*FEATURES, "target"])
    cuts = binning.equal_frequency_cuts(app.where(F.col("target") == "train"), FEATURES)
    counted = binning.bin_counts(app, cuts, None).join(binning.edge_frame(spark, cuts), ["feature", "bin"])
    return counted.select(
        "feature", "bin", (F.col("bin_range") == "(null)").alias("is_missing"),
        F.round(F.when(F.col("low") > float("-inf"), F.col("low")), 4).alias("low"), F.col("total").alias("n")
    ).orderBy("feature", "bin")


@query("explore_quantile_bins", on_app(
    woe_select(["feature"]), long_part(["amount"]),
    "pair AS (SELECT * FROM long WHERE value IS NOT NULL AND label IS NOT NULL)",
    cuts_part("true", source="pair", probabilities="[0.125,0.25,0.375,0.5,0.625,0.75,0.875]"),
    binned_part(source="pair"), woe_part(["feature"])))
def explore_quantile_bins(spark, folder):
    app = kept_applications(spark, folder, ["amount", "label"])
    return woe_columns(binning.binning_explorer(app, "amount", method="quantile", n_bins=8), ["feature"])


@query("explore_tree_bins", on_app(
    woe_select(["feature"]), long_part(["qty"]), stump(0.1),
    "cuts AS (SELECT feature, [(value + following) / 2] AS cuts FROM s "
    "QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, value) = 1)",
    "pair AS (SELECT * FROM long WHERE value IS NOT NULL)", binned_part(source="pair"), woe_part(["feature"])))
def explore_tree_bins(spark, folder):
    app = kept_applications(spark, folder, ["qty", "label"])
    return woe_columns(binning.binning_explorer(app, "qty", method="decision_tree", min_samples_leaf=0.1,
                                                max_leaf_nodes=2), ["feature"])


@query("explore_chi_bins", recursive(on_app(
    woe_select(["feature"]), long_part(["amount"]), *chi_parts(6), "cuts AS (SELECT feature, e[:len(e) - 1] AS cuts FROM merged)",
    "pair AS (SELECT * FROM long WHERE value IS NOT NULL)", binned_part(source="pair"), woe_part(["feature"]))))
def explore_chi_bins(spark, folder):
    app = kept_applications(spark, folder, ["amount", "label"])
    return woe_columns(binning.binning_explorer(app, "amount", method="chi", n_bins=6), ["feature"])


# ---------------------------------------------------------------- WOE and IV

def app_and_cuts(spark, folder, features=FEATURES, extra=()):
    app = kept_applications(spark, folder, [*features, "label", "target", *extra])
    return app, binning.equal_frequency_cuts(app.where(F.col("target") == "train"), features)


BINNED = (long_part(), cuts_part(), binned_part())


@query("woe_table_by_set", on_app(woe_select(["feature", "target"]), *BINNED, woe_part(["feature", "target"])))
def woe_table_by_set(spark, folder):
    app, cuts = app_and_cuts(spark, folder)
    return woe_columns(woe.woe_table(app, cuts, by=["target"]), ["feature", "target"])


@query("woe_detail", on_app(
    """SELECT feature, CAST(bin AS INT) AS bin, CAST(good AS BIGINT) AS good, CAST(bad AS BIGINT) AS bad,
      CAST(total AS BIGINT) AS total, """ + r6(
        "good_pct", "bad_pct", "total_pct", "bad_rate", ("bad_cum_rate", "bad_pct_cumsum"),
        ("good_cum_rate", "good_pct_cumsum"), ("abs(bad_cum_rate - good_cum_rate) * 100", "ks_pct"), "lift",
        ("(bad - tb / tt * total) ** 2 / (tb / tt * total)", "chi_square"), "woe", "iv", "total_iv",
        ("good / tt", "good_distr"), ("bad / tt", "bad_distr")) + " FROM woe",
    long_part(), cuts_part("true", "[0.5]", "halves"), cuts_part("true"),
    "picked AS (SELECT feature, CASE WHEN feature IN ('amount', 'qty') THEN h.cuts ELSE c.cuts END AS cuts "
    "FROM cuts c JOIN halves h USING (feature))",
    "pair AS (SELECT * FROM long WHERE value IS NOT NULL)", binned_part(source="pair", cuts="picked"),
    woe_part(["feature"])))
def woe_detail(spark, folder):
    app = kept_applications(spark, folder, [*FEATURES, "label"])
    edges = binning.equal_frequency_cuts(app, FEATURES)
    open_ended = [float("-inf"), float("inf")]
    table = woe.woe_detail(app, {**edges, "amount": open_ended, "qty": open_ended})
    return rounded(table.drop("low", "high", "bin_range"))


SIMPLE_IV_PARTS = (
    long_part(),
    "own AS (SELECT feature, target, list_distinct(quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS cuts, "
    "min(value) AS lo, max(value) AS hi FROM long GROUP BY feature, target)",
    # Inner edges equal to an end are no edges of their own.
    "sb AS (SELECT feature, target, label, CASE WHEN value = lo THEN 1 ELSE 1 + len(list_filter(cuts, lambda c: c < value AND c > lo)) END AS bin "
    "FROM long JOIN own USING (feature, target) WHERE value IS NOT NULL)",
    "sc AS (SELECT feature, target, bin, SUM(label)::DOUBLE AS b, (COUNT(label) - SUM(label))::DOUBLE AS g FROM sb GROUP BY ALL)",
    "sp AS (SELECT feature, target, g / SUM(g) OVER k AS gp, b / SUM(b) OVER k AS bp FROM sc "
    "WINDOW k AS (PARTITION BY feature, target))",
    "siv AS (SELECT feature, target, SUM((gp - bp) * ln((gp + 1e-10) / (bp + 1e-10))) AS iv FROM sp GROUP BY feature, target)")


@query("simple_iv_by_set", on_app(
    "SELECT feature, target, round(iv, 6) AS iv FROM siv UNION ALL SELECT DISTINCT 'segment', target, 0.0 FROM app",
    *SIMPLE_IV_PARTS))
def simple_iv_by_set(spark, folder):
    app = kept_applications(spark, folder, [*FEATURES, "segment", "label", "target"])
    return rounded(woe.simple_iv(app, [*FEATURES, "segment"], by="target"))


def per_set(column, suffix):
    return ", ".join(f"round(max(CASE WHEN target = '{s}' THEN {column} END), 6) AS {s}_{suffix}" for s in SETS)


@query("iv_by_set", on_app(f"SELECT feature, {per_set('total_iv', 'iv')} FROM woe GROUP BY feature",
                           *BINNED, woe_part(["feature", "target"])))
def iv_by_set(spark, folder):
    app, cuts = app_and_cuts(spark, folder)
    return rounded(woe.iv_by_set(app, cuts))


@query("iv_by_set_tree", on_app(
    f"SELECT feature, {per_set('total_iv', 'iv')} FROM woe GROUP BY feature", long_part(), *tree_parts(10, 0.02, "target = 'train' AND label IN (0, 1)"),
    "cuts AS (SELECT feature, list(cut) AS cuts FROM tree_cuts GROUP BY feature)", binned_part(), woe_part(["feature", "target"])))
def iv_by_set_tree(spark, folder):
    app = kept_applications(spark, folder, [*FEATURES, "label", "target"])
    return rounded(woe.iv_by_set(app, woe.learn_edges(app, FEATURES)))


@query("woe_detail_all_rows", on_app(woe_select(["feature"]), *BINNED, woe_part(["feature"])))
def woe_detail_all_rows(spark, folder):
    app, cuts = app_and_cuts(spark, folder)
    return woe_columns(woe.detail_report(app, cuts, "all"), ["feature"])


@query("woe_detail_one_set", on_app(woe_select(["feature"]) + " WHERE target = 'valid'", *BINNED,
                                    woe_part(["feature", "target"])))
def woe_detail_one_set(spark, folder):
    app, cuts = app_and_cuts(spark, folder)
    return woe_columns(woe.detail_report(app, cuts, "valid"), ["feature"])


PAIRS = [("train", "valid"), ("train", "oot"), ("valid", "oot")]


@query("compare_sets", on_app(
    "SELECT feature, " + ", ".join(f"round(max(total_iv_{s}), 6) AS {s}_iv" for s in SETS) + ", " + ", ".join(
        f"round(SUM((total_pct_{a} - total_pct_{b}) * ln(total_pct_{a} / total_pct_{b})), 6) AS {a}_{b}_psi, "
        f"round(max(total_iv_{a}) - max(total_iv_{b}), 6) AS {a}_{b}_iv_diff, "
        f"round((max(total_iv_{a}) - max(total_iv_{b})) / max(total_iv_{a}), 6) AS {a}_{b}_iv_diff_ratio" for a, b in PAIRS)
    + " FROM w GROUP BY feature",
    *BINNED, woe_part(["feature", "target"]),
    "w AS (SELECT feature, bin, " + ", ".join(
        f"max(CASE WHEN target = '{s}' THEN {c} END) AS {c}_{s}" for s in SETS for c in ("total_pct", "total_iv"))
    + " FROM woe GROUP BY feature, bin)"))
def compare_sets(spark, folder):
    app, cuts = app_and_cuts(spark, folder)
    return rounded(woe.compare_report(app, cuts))


@query("feature_report", on_app(
    "SELECT feature, round(iv, 6) AS iv, round(COUNT(*) FILTER (value IS NULL) / COUNT(*), 4) AS missing_rate, "
    "'double' AS data_type, COUNT(DISTINCT value) AS n_distinct FROM alls JOIN siv USING (feature) GROUP BY feature, iv "
    "UNION ALL SELECT 'segment', 0.0, round(COUNT(*) FILTER (segment IS NULL) / COUNT(*), 4), 'string', "
    "COUNT(DISTINCT segment) FROM app",
    *[p.replace("long AS (", "alls AS (") if p.startswith("long AS") else p for p in SIMPLE_IV_PARTS[:1]],
    "long AS (SELECT feature, app_id, 'all' AS target, month_time, label, value FROM alls)", *SIMPLE_IV_PARTS[1:]))
def feature_report(spark, folder):
    return woe.feature_report(kept_applications(spark, folder, [*FEATURES, "segment", "label"]), [*FEATURES, "segment"])


PAIRWISE_PARTS = (
    cuts_part(), binned_part("pb"),
    "pc AS (SELECT feature, bin, " + ", ".join(f"CAST(COUNT(*) FILTER (target = '{s}') AS DOUBLE) AS {s[0]}" for s in SETS)
    + " FROM pb WHERE value IS NOT NULL GROUP BY feature, bin)",
    "ps AS (SELECT feature, " + ", ".join(
        f"CASE WHEN {k} = 0 THEN 1e-6 ELSE {k} / SUM({k}) OVER (PARTITION BY feature) END AS {k}" for k in "tvo") + " FROM pc)",
    "pp AS (SELECT feature, " + ", ".join(
        f"SUM(({b} - {a}) * ln({b} / {a})) AS psi_{a}{b}" for a, b in ("tv", "to", "vo")) + " FROM ps GROUP BY feature)")


@query("feature_metrics", on_app(
    "SELECT feature, " + ", ".join(f"round(max(CASE WHEN target = '{s}' THEN iv END), 6) AS iv_{s}" for s in SETS)
    + ", " + r6("any_value(psi_tv)", "any_value(psi_to)", "any_value(psi_vo)").replace(" AS any_value(psi_tv)", " AS psi_tv")
    .replace(" AS any_value(psi_to)", " AS psi_to").replace(" AS any_value(psi_vo)", " AS psi_vo")
    + " FROM siv JOIN pp USING (feature) GROUP BY feature UNION ALL SELECT 'segment', 0.0, 0.0, 0.0, 0.0, 0.0, 0.0",
    *SIMPLE_IV_PARTS, *PAIRWISE_PARTS))
def feature_metrics(spark, folder):
    app = kept_applications(spark, folder, [*FEATURES, "segment", "label", "target"])
    return rounded(woe.multi_set_metrics(app, [*FEATURES, "segment"]))


@query("ks_by_set", on_app(f"SELECT feature, {per_set('ks', 'ks')} FROM woe GROUP BY feature",
                           *BINNED, woe_part(["feature", "target"])))
def ks_by_set(spark, folder):
    app, cuts = app_and_cuts(spark, folder)
    return rounded(woe.ks_by_set(app, cuts))


@query("total_iv", on_app("SELECT feature, round(SUM(iv), 6) AS total_iv, COUNT(*) AS n_bins FROM woe GROUP BY feature",
                          *BINNED, woe_part(["feature"])))
def total_iv(spark, folder):
    app, cuts = app_and_cuts(spark, folder)
    return rounded(woe.total_iv(woe.woe_table(app, cuts)))


# ---------------------------------------------------------------- stability

SCOPED_ENDS = (
    "ends AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM long WHERE target IN ('train', 'oot') GROUP BY feature)",
    "edges AS (SELECT feature, lo, hi, list_transform(range(11), lambda i: CASE WHEN i = 10 THEN hi "
    "ELSE i * ((hi - lo) / 10) + lo END) AS e FROM ends)")


def side_parts(bin_expression):
    return (
        f"sides AS (SELECT feature, {bin_expression} AS bin, COUNT(*) FILTER (target = 'train') AS x, "
        "COUNT(*) FILTER (target = 'oot') AS a FROM long JOIN edges USING (feature) "
        "WHERE value IS NOT NULL AND target IN ('train', 'oot') GROUP BY ALL)",
        "dense AS (SELECT feature, i AS bin, e[i] AS low, e[i + 1] AS high, COALESCE(x, 0) AS x, COALESCE(a, 0) AS a "
        "FROM (SELECT feature, e, unnest(range(1, len(e))) AS i FROM edges) b LEFT JOIN sides s ON b.feature = s.feature AND b.i = s.bin)"
        .replace("SELECT feature, i AS bin", "SELECT b.feature, i AS bin"),
        "shared AS (SELECT *, x / SUM(x) OVER k AS xs, a / SUM(a) OVER k AS sa FROM dense WINDOW k AS (PARTITION BY feature))",
        "terms AS (SELECT *, CASE WHEN xs = 0 THEN 1e-6 ELSE xs END AS xp, CASE WHEN sa = 0 THEN 1e-6 ELSE sa END AS ap FROM shared)")


RIGHT_LOWEST = "greatest(len(list_filter(e, lambda c: c < value)), 1)"
LEFT_HIGHEST = "least(len(list_filter(e, lambda c: c <= value)), len(e) - 1)"


@query("psi_detail", on_app(
    """SELECT CAST(bin AS INT) AS bin, x AS expected, round(xs * 100, 6) AS expected_pct, a AS actual,
      round(round(sa * 100, 2), 6) AS actual_pct, round((sa - xs) * 100, 2) AS diff_pct, round(ln(ap / xp), 6) AS ln_ratio,
      round((ap - xp) * ln(ap / xp), 6) AS psi, (ap - xp) * ln(ap / xp) = max((ap - xp) * ln(ap / xp)) OVER () AS is_max FROM terms
    UNION ALL SELECT 0, CAST(SUM(x) AS BIGINT), 100.0, CAST(SUM(a) AS BIGINT), 100.0, NULL, NULL,
      round(SUM((ap - xp) * ln(ap / xp)), 6), false FROM terms""",
    long_part(["amount"]), *SCOPED_ENDS, *side_parts(RIGHT_LOWEST)))
def psi_detail(spark, folder):
    app = kept_applications(spark, folder, ["amount", "target"])
    detail = psi.psi_detail(app, "amount", F.col("target") == "train", F.col("target") == "oot")
    return rounded(detail.drop("score_range"))


@query("psi_compact", on_app(
    "SELECT feature, round(SUM((ap - xp) * ln(ap / xp)), 6) AS psi FROM terms GROUP BY feature",
    long_part(),
    "edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]))) AS e "
    "FROM long WHERE target IN ('train', 'oot') GROUP BY feature)", *side_parts(LEFT_HIGHEST)))
def psi_compact(spark, folder):
    app = kept_applications(spark, folder, [*FEATURES, "target"])
    return rounded(psi.psi_between(app, FEATURES, F.col("target") == "train", F.col("target") == "oot",
                                   method="equal_frequency"))


@query("psi_filter", on_app(
    "SELECT feature, round(psi, 6) AS psi, psi <= 0.003 AS kept FROM "
    "(SELECT feature, SUM((ap - xp) * ln(ap / xp)) AS psi FROM terms GROUP BY feature)",
    long_part(), *SCOPED_ENDS, *side_parts(LEFT_HIGHEST)))
def psi_filter(spark, folder):
    app = kept_applications(spark, folder, [*FEATURES, "target"])
    return rounded(psi.psi_filter(app, FEATURES, threshold=0.003))


@query("psi_by_month", on_app(
    """SELECT month_time AS month, round(SUM((ap - xp) * ln(ap / xp)), 6) AS psi FROM (
      SELECT month_time, CASE WHEN x = 0 THEN 1e-6 ELSE x / SUM(x) OVER k END AS xp,
        CASE WHEN a = 0 THEN 1e-6 ELSE a / SUM(a) OVER k END AS ap FROM mb WINDOW k AS (PARTITION BY month_time))
    GROUP BY month_time""",
    "me AS (SELECT month_time, min(amount) AS l, max(amount) AS h FROM app GROUP BY month_time)",
    "b AS (SELECT l, h FROM me WHERE month_time = (SELECT min(month_time) FROM me))",
    "edges AS (SELECT month_time, list_transform(range(11), lambda i: CASE WHEN i = 10 THEN greatest(me.h, b.h) ELSE "
    "i * ((greatest(me.h, b.h) - least(me.l, b.l)) / 10) + least(me.l, b.l) END) AS e FROM me, b)",
    "mx AS (SELECT e.month_time, least(len(list_filter(e.e, lambda c: c <= amount)), 10) AS bin, COUNT(*) AS x "
    "FROM edges e, app WHERE app.month_time = (SELECT min(month_time) FROM me) GROUP BY ALL)",
    "ma AS (SELECT app.month_time, least(len(list_filter(e.e, lambda c: c <= amount)), 10) AS bin, COUNT(*) AS a "
    "FROM edges e JOIN app ON app.month_time = e.month_time GROUP BY ALL)",
    "mb AS (SELECT d.month_time, d.bin, COALESCE(x, 0) AS x, COALESCE(a, 0) AS a FROM "
    "(SELECT month_time, unnest(range(1, 11)) AS bin FROM edges) d LEFT JOIN mx ON mx.month_time = d.month_time AND mx.bin = d.bin "
    "LEFT JOIN ma ON ma.month_time = d.month_time AND ma.bin = d.bin)"))
def psi_by_month(spark, folder):
    return rounded(psi.month_psi(kept_applications(spark, folder, ["amount", "month_time"]), "amount"))


@query("psi_between_sets", on_app("SELECT feature, " + r6("psi_tv", "psi_to", "psi_vo") + " FROM pp",
                                  long_part(), *PAIRWISE_PARTS))
def psi_between_sets(spark, folder):
    return rounded(psi.pairwise_psi(kept_applications(spark, folder, [*FEATURES, "target"]), FEATURES))


REPORT_CUTS = "rc AS (SELECT quantile_cont(proba, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS cuts FROM app WHERE target = 'train')"
REPORT_BIN = "1 + len(list_filter(rc.cuts, lambda c: c < proba))"


@query("report_psi", on_app(
    """SELECT 'train_vs_oot_psi' AS metric, round(SUM((a - x) * ln(a / x)), 6) AS value FROM (
      SELECT greatest(COUNT(*) FILTER (target = 'train') / SUM(COUNT(*) FILTER (target = 'train')) OVER (), 1e-6) AS x,
             greatest(COUNT(*) FILTER (target = 'oot') / SUM(COUNT(*) FILTER (target = 'oot')) OVER (), 1e-6) AS a
      FROM rb GROUP BY bin)""",
    REPORT_CUTS, f"rb AS (SELECT target, month_time, {REPORT_BIN} AS bin FROM app, rc)"))
def report_psi(spark, folder):
    return rounded(psi.report_psi(kept_applications(spark, folder, ["proba", "target"])))


@query("report_month_psi", on_app(
    """SELECT month_time AS month, round(SUM((a - x) * ln(a / x)), 6) AS psi,
      month_time = (SELECT min(month_time) FROM app) AS is_baseline FROM (
      SELECT m.month_time, greatest(COALESCE(m.n, 0) / m.t, 1e-6) AS a, greatest(COALESCE(b.n, 0) / b.t, 1e-6) AS x
      FROM d m JOIN d b ON m.bin = b.bin AND b.month_time = (SELECT min(month_time) FROM app)) GROUP BY month_time""",
    REPORT_CUTS, f"rb AS (SELECT month_time, {REPORT_BIN} AS bin, COUNT(*) AS n FROM app, rc GROUP BY ALL)",
    "d AS (SELECT g.month_time, g.bin, n, SUM(n) OVER (PARTITION BY g.month_time) AS t FROM "
    "(SELECT month_time, unnest(range(1, 11)) AS bin FROM (SELECT DISTINCT month_time FROM app)) g "
    "LEFT JOIN rb ON rb.month_time = g.month_time AND rb.bin = g.bin)"))
def report_month_psi(spark, folder):
    return rounded(psi.report_month_psi(kept_applications(spark, folder, ["proba", "target", "month_time"])))


@query("psi_of_event_values", """
WITH e AS (SELECT *, CASE WHEN ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) THEN 'first' ELSE 'second' END AS half
  FROM events),
ends AS (SELECT min(value) AS lo, max(value) AS hi FROM e),
edges AS (SELECT list_transform(range(11), lambda i: CASE WHEN i = 10 THEN hi ELSE i * ((hi - lo) / 10) + lo END) AS e FROM ends),
c AS (SELECT i AS bin, COUNT(value) FILTER (half = 'first') AS x, COUNT(value) FILTER (half = 'second') AS a
  FROM (SELECT unnest(range(1, 11)) AS i) LEFT JOIN (SELECT half, value, least(len(list_filter(edges.e, lambda c: c <= value)), 10) AS bin
    FROM e, edges) ON bin = i GROUP BY i),
s AS (SELECT CASE WHEN x = 0 THEN 1e-6 ELSE x / SUM(x) OVER () END AS xp, CASE WHEN a = 0 THEN 1e-6 ELSE a / SUM(a) OVER () END AS ap FROM c)
SELECT 'value' AS feature, round(SUM((ap - xp) * ln(ap / xp)), 6) AS psi FROM s""")
def psi_of_event_values(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    ends = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).select(
        F.timestamp_micros(((F.unix_micros("low") + F.unix_micros("high")) / 2).cast("long")).alias("middle")).first()
    first = F.col("ts") < F.lit(ends["middle"])
    return rounded(psi.psi_between(events, ["value"], first, ~first))
