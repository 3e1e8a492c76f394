"""Queries on screening, scores and model quality."""

from pyspark.sql import functions as F

from ...functions.guards import numeric_columns
from ...functions.scores import probability_to_score
from ...operators import evaluate, psi, scoring, screen, woe
from ..loanbook import NUMERIC_FEATURES, applications, kept_applications
from .registry import long_part, on_app, query, r6, rounded
from .bins import PAIRWISE_PARTS, SIMPLE_IV_PARTS

FEATURES = NUMERIC_FEATURES


# ---------------------------------------------------------------- screening

def widened(spark, folder, columns):
    """The application table with a near-constant, a constant, an empty and two duplicate columns."""
    app = kept_applications(spark, folder, sorted({*columns, "app_id", "amount", "qty"}))
    return app.withColumns({
        "rare": F.when(F.col("app_id") % 50 == 0, 1.0).otherwise(0.0), "always": F.lit(1.0),
        "never": F.lit(None).cast("double"), "mostly_a": F.when(F.col("app_id") % 50 == 0, "b").otherwise("a"),
        "twice": F.col("amount") * 2 + 1, "summed": F.col("amount") + F.col("qty")})


WIDE_PART = ("wide AS (SELECT *, CASE WHEN app_id % 50 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rare, 1.0::DOUBLE AS always, "
             "CAST(NULL AS DOUBLE) AS never, CASE WHEN app_id % 50 = 0 THEN 'b' ELSE 'a' END AS mostly_a, amount * 2 + 1 AS twice, "
             "amount + qty AS summed FROM app)")
SCREENED = [*FEATURES, "segment", "rare", "always", "never", "mostly_a"]


@query("screen_basic", on_app(
    "SELECT column_name, round(miss, 6) AS missing_rate, round(std, 6) AS std, "
    "NOT (miss >= 0.95 OR COALESCE(top, 0) >= 0.95 OR COALESCE(std, 1) = 0) AS kept, CASE WHEN miss >= 0.95 THEN 'missing' "
    "WHEN top >= 0.95 THEN 'freq' WHEN std = 0 THEN 'zero_std' END AS reason FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, (SELECT COUNT(*) FILTER ({c} IS NULL) / COUNT(*) FROM wide) AS miss, "
        + (f"(SELECT stddev_samp({c}) FROM wide)" if c not in ("segment", "mostly_a") else "CAST(NULL AS DOUBLE)") + " AS std, "
        f"(SELECT max(n) / SUM(n) FROM (SELECT COUNT(*) AS n FROM wide WHERE {c} IS NOT NULL GROUP BY {c})) AS top"
        for c in SCREENED) + ")", WIDE_PART))
def screen_basic(spark, folder):
    return rounded(screen.screen_basic(widened(spark, folder, [*FEATURES, "segment"]), SCREENED))


METRIC_PARTS = (*SIMPLE_IV_PARTS, *PAIRWISE_PARTS)
TRAIN_IV = "SELECT feature, iv AS iv_train FROM siv WHERE target = 'train'"


@query("screen_by_iv", on_app(
    "SELECT feature, round(iv, 6) AS iv FROM siv WHERE target = 'train' AND iv < 0.02", *SIMPLE_IV_PARTS))
def screen_by_iv(spark, folder):
    app = kept_applications(spark, folder, [*FEATURES, "label", "target"])
    return rounded(screen.iv_screen(woe.multi_set_metrics(app, FEATURES), 0.02))


@query("screen_by_psi", on_app(
    "SELECT feature, " + r6("psi_tv", "psi_to") + " FROM pp WHERE psi_tv > 0.004 OR psi_to > 0.004",
    long_part(), *PAIRWISE_PARTS))
def screen_by_psi(spark, folder):
    app = kept_applications(spark, folder, [*FEATURES, "label", "target"])
    return rounded(screen.psi_screen(woe.multi_set_metrics(app, FEATURES), 0.004))


CORRELATED = [*FEATURES, "twice", "summed"]
CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS corr FROM wide"
    for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1:])


@query("correlation_pairs", on_app(CORR_SQL, WIDE_PART))
def correlation_pairs(spark, folder):
    return rounded(screen.correlation_pairs(widened(spark, folder, FEATURES), CORRELATED))


@query("correlation_prune", on_app(
    "SELECT DISTINCT CASE WHEN round(COALESCE(a.iv, 0), 10) >= round(COALESCE(b.iv, 0), 10) THEN feature_b ELSE feature_a END AS feature FROM cp "
    "LEFT JOIN ivs a ON a.feature = feature_a LEFT JOIN ivs b ON b.feature = feature_b WHERE abs(corr) >= 0.9",
    WIDE_PART, long_part([*CORRELATED], "alls", "wide"),
    "long AS (SELECT feature, app_id, 'train' AS target, label, value FROM alls)", *SIMPLE_IV_PARTS[1:],
    "ivs AS (SELECT feature, iv FROM siv)", f"cp AS ({CORR_SQL})"))
def correlation_prune(spark, folder):
    app = widened(spark, folder, [*FEATURES, "label"])
    return screen.correlation_prune(screen.correlation_pairs(app, CORRELATED), woe.simple_iv(app, CORRELATED))


FILTERED = [*FEATURES, "rare", "never", "twice"]
FILTER_PARTS = (
    WIDE_PART, long_part(FILTERED, "long", "wide"), *SIMPLE_IV_PARTS[1:], *PAIRWISE_PARTS,
    "basic AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {i} AS position, CASE WHEN COUNT(*) FILTER ({c} IS NULL) / COUNT(*) >= 0.95 THEN 'missing' "
        f"WHEN (SELECT max(n) / SUM(n) FROM (SELECT COUNT(*) AS n FROM wide WHERE target = 'train' AND {c} IS NOT NULL GROUP BY {c})) >= 0.95 "
        f"THEN 'freq' END AS reason FROM wide WHERE target = 'train'" for i, c in enumerate(FILTERED)) + ")",
    "l2 AS (SELECT b.feature, position, CASE WHEN reason IS NULL THEN s.iv END AS iv, COALESCE(reason, CASE WHEN s.iv < 0.01 THEN 'iv' "
    "WHEN greatest(psi_tv, psi_to) > 0.006 THEN 'psi' END) AS reason FROM basic b "
    "LEFT JOIN siv s ON s.feature = b.feature AND s.target = 'train' LEFT JOIN pp ON pp.feature = b.feature)",
    "cp AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS fa, '{b}' AS fb, corr({a}, {b}) AS c FROM wide WHERE target = 'train'"
        for i, a in enumerate(FILTERED) for b in FILTERED[i + 1:] if "rare" not in (a, b) and "never" not in (a, b)) + ")",
    "cd AS (SELECT DISTINCT CASE WHEN round(a.iv, 10) >= round(b.iv, 10) THEN fb ELSE fa END AS feature FROM cp JOIN l2 a ON a.feature = fa AND a.reason IS NULL "
    "JOIN l2 b ON b.feature = fb AND b.reason IS NULL WHERE abs(c) >= 0.9)",
    "verdict AS (SELECT l2.feature, position, iv, CASE WHEN reason IS NOT NULL THEN reason WHEN cd.feature IS NOT NULL THEN 'corr' END AS reason "
    "FROM l2 LEFT JOIN cd ON cd.feature = l2.feature)")


def filtered(spark, folder):
    app = widened(spark, folder, [*FEATURES, "label", "target"])
    return screen.filter_features(app, FILTERED, iv=0.01, psi=0.006)


@query("filter_features", on_app(
    "SELECT feature, position, reason IS NULL AS kept, reason, round(iv, 6) AS iv_train FROM verdict", *FILTER_PARTS))
def filter_features(spark, folder):
    return rounded(filtered(spark, folder))


@query("filter_summary", on_app(
    "SELECT COUNT(*) AS total_input, COUNT(*) FILTER (reason IS NULL) AS total_kept, COUNT(reason) AS total_dropped, "
    + ", ".join(f"COUNT(*) FILTER (reason = '{r}') AS drop_by_{r}" for r in ("missing", "freq", "zero_std", "iv", "psi", "corr"))
    + " FROM verdict", *FILTER_PARTS))
def filter_summary(spark, folder):
    return screen.filter_summary(filtered(spark, folder))


@query("top_features", on_app(
    "SELECT feature, round(iv, 4) AS iv_train, round(psi_tv, 4) AS psi_tv, round(psi_to, 4) AS psi_to FROM siv "
    "JOIN pp USING (feature) WHERE target = 'train' AND iv >= 0.01 ORDER BY iv DESC, feature LIMIT 10", *METRIC_PARTS))
def top_features(spark, folder):
    app = kept_applications(spark, folder, [*FEATURES, "label", "target"])
    return screen.top_features(woe.multi_set_metrics(app, FEATURES))


# ---------------------------------------------------------------- scores

SCORE = ("(600 - 20 / ln(2) * ln(50) + 20 / ln(2) * (ln(1 - least(greatest(proba, 1e-6), 1 - 1e-6)) "
         "- ln(least(greatest(proba, 1e-6), 1 - 1e-6))))")
SCORED = f"scored AS (SELECT *, {SCORE} AS score FROM app)"


def scored(spark, folder, columns):
    return scoring.with_score(kept_applications(spark, folder, sorted({*columns, "proba"})))


@query("probability_to_score", on_app(
    "SELECT app_id, round(score, 6) AS score, round(750 - 30 / ln(2) * ln(35) + 30 / ln(2) * (ln(1 - proba) - ln(proba)), 6) "
    "AS default_score FROM scored", SCORED))
def score_points(spark, folder):
    return rounded(scored(spark, folder, ["app_id"]).select(
        "app_id", "score", probability_to_score("proba").alias("default_score")))


@query("auto_scale", on_app(
    """, w AS (SELECT min(ln(1 - proba) - ln(proba)) / ln(2) AS a, max(ln(1 - proba) - ln(proba)) / ln(2) AS b FROM app),
p AS (SELECT 1 AS one, 20 AS pdo, (b - a) * 20 AS span, 0 AS i FROM w
      UNION ALL SELECT 1, CASE WHEN span >= 600 THEN greatest(1, pdo - 5) ELSE pdo + 5 END,
        (SELECT b - a FROM w) * CASE WHEN span >= 600 THEN greatest(1, pdo - 5) ELSE pdo + 5 END, i + 1
      FROM p WHERE (span >= 600 OR span <= 360) AND i < 50),
f AS (SELECT pdo FROM p ORDER BY i DESC LIMIT 1),
s AS (SELECT 600 AS base, 0 AS i FROM f
      UNION ALL SELECT base + CASE WHEN low < 300 THEN 50 ELSE 0 END - CASE WHEN high > 900 THEN 50 ELSE 0 END, i + 1
      FROM (SELECT base, i, base + f.pdo * (w.a - ln(50) / ln(2)) AS low, base + f.pdo * (w.b - ln(50) / ln(2)) AS high FROM s, f, w)
      WHERE (low < 300 OR high > 900) AND i < 50)
SELECT CAST(base AS DOUBLE) AS base_score, 50.0::DOUBLE AS base_odds, CAST((SELECT pdo FROM f) AS DOUBLE) AS pdo, true AS converged
FROM s ORDER BY i DESC LIMIT 1""").replace("WITH ", "WITH RECURSIVE ", 1).replace("\n, w AS", ", w AS"))
def auto_scale(spark, folder):
    return scoring.auto_scale_frame(applications(spark, folder, ["proba"]))


DIST_PARTS = (SCORED, "ends AS (SELECT min(score) AS lo, max(score) AS hi FROM scored)")


def hist_bin(n):
    return f"least(len(list_filter(range(0, {n + 1}), lambda i: (CASE WHEN i = {n} THEN hi ELSE i * ((hi - lo) / {n}) + lo END) <= score)), {n})"


@query("score_distribution", on_app(
    f"SELECT CAST(b AS INT) AS bin, COUNT(*) FILTER (label = 0) AS good, COUNT(*) FILTER (label = 1) AS bad, "
    "(SELECT round(avg(score), 6) FROM scored WHERE label = 0) AS avg_good, (SELECT round(avg(score), 6) FROM scored WHERE label = 1) AS avg_bad "
    f"FROM (SELECT unnest(range(1, 21)) AS b) LEFT JOIN (SELECT label, {hist_bin(20)} AS bin FROM scored, ends) ON bin = b GROUP BY b",
    *DIST_PARTS))
def score_distribution(spark, folder):
    one = evaluate.score_distribution(scored(spark, folder, ["label"]))
    both = F.arrays_zip("counts_good", "counts_bad")
    return rounded(one.select("avg_good", "avg_bad", F.posexplode(both).alias("pos", "c")).select(
        (F.col("pos") + 1).cast("int").alias("bin"), F.col("c.counts_good").alias("good"), F.col("c.counts_bad").alias("bad"),
        "avg_good", "avg_bad"))


@query("score_histogram", on_app(
    "SELECT CAST(b AS INT) AS bin, COUNT(score) AS n, (SELECT COUNT(*) FROM scored) AS sample_size, "
    "(SELECT round(avg(score), 6) FROM scored) AS avg_score, (SELECT round(min(score), 6) FROM scored) AS min_score, "
    "(SELECT round(max(score), 6) FROM scored) AS max_score, (SELECT round(stddev_pop(score), 6) FROM scored) AS std_score "
    f"FROM (SELECT unnest(range(1, 11)) AS b) LEFT JOIN (SELECT score, {hist_bin(10)} AS bin FROM scored, ends) ON bin = b GROUP BY b",
    *DIST_PARTS))
def score_histogram(spark, folder):
    one = evaluate.score_histogram(scored(spark, folder, []))
    return rounded(one.select("sample_size", "avg_score", "min_score", "max_score", "std_score",
                              F.posexplode("counts").alias("pos", "n")).withColumn(
        "bin", (F.col("pos") + 1).cast("int")).drop("pos"))


# ---------------------------------------------------------------- quality

def ranking_parts(keys, score, source, weight="1.0::DOUBLE", label="label"):
    """Named parts: weighted KS and AUC per ``keys``, equal scores summed first."""
    k = f"{keys}, " if keys else ""
    over = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return (
        f"rk AS (SELECT {k}{score} AS s, SUM(CASE WHEN {label} = 0 THEN {weight} ELSE 0 END) AS g, "
        f"SUM(CASE WHEN {label} = 1 THEN {weight} ELSE 0 END) AS b FROM {source} GROUP BY {k}{score})",
        f"rc2 AS (SELECT *, SUM(g) OVER ({over}ORDER BY s ROWS UNBOUNDED PRECEDING) AS cg, SUM(b) OVER ({over}ORDER BY s "
        f"ROWS UNBOUNDED PRECEDING) AS cb, SUM(g) OVER ({over}) AS tg, SUM(b) OVER ({over}) AS tb FROM rk)",
        f"ranked AS (SELECT {k}CASE WHEN any_value(tg) * any_value(tb) = 0 THEN 0.0 ELSE max(abs(cg / tg - cb / tb)) END AS ks, "
        f"CASE WHEN any_value(tg) * any_value(tb) = 0 THEN 0.5 ELSE SUM(b * (cg - g + g / 2)) / (any_value(tg) * any_value(tb)) END AS auc "
        f"FROM rc2 {group})")


@query("ks_auc_weighted", on_app("SELECT target, round(ks, 6) AS ks, round(auc, 6) AS auc FROM ranked",
                                 *ranking_parts("target", "proba", "app", "weight")))
def ks_auc_weighted(spark, folder):
    app = kept_applications(spark, folder, ["proba", "label", "target", "weight"])
    return rounded(evaluate.ks_auc(app, ["target"], weight="weight"))


@query("ks_auc_documents", "WITH d AS (SELECT toxic AS label, CAST(n_chars AS DOUBLE) AS n_chars, lang FROM documents JOIN labels "
       "USING (doc_id)), " + ", ".join(ranking_parts("lang", "n_chars", "d")) + " SELECT lang, round(ks, 6) AS ks, round(auc, 6) AS auc FROM ranked")
def ks_auc_documents(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "n_chars", "lang")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    return rounded(evaluate.ks_auc(documents.join(labels, "doc_id"), ["lang"], score="n_chars"))


PERFORMANCE_PARTS = (
    "both_keys AS (SELECT target AS datasets, proba, label FROM app UNION ALL SELECT month_time, proba, label FROM app)",
    *ranking_parts("datasets", "proba", "both_keys"))


@query("performance", on_app("SELECT datasets, round(auc, 6) AS auc, round(ks, 6) AS ks FROM ranked", *PERFORMANCE_PARTS))
def performance(spark, folder):
    return rounded(evaluate.performance(kept_applications(spark, folder, ["proba", "label", "target", "month_time"])))


@query("score_ks_table", on_app(
    """SELECT CAST(bucket AS INT) AS bucket, """ + r6(("e[bucket]", "min"), ("e[bucket + 1]", "max"), ("bad / n", "bad_rate"),
      ("n / SUM(n) OVER ()", "total_prop"), ("SUM(bad) OVER o / SUM(n) OVER o", "cum_bad_rate"),
      ("SUM(n) OVER o / SUM(n) OVER ()", "cum_total_prop")) + """ FROM bk WINDOW o AS (ORDER BY bucket ROWS UNBOUNDED PRECEDING)""",
    SCORED, "q AS (SELECT list_sort(list_distinct(quantile_cont(score, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]))) AS e FROM scored)",
    "bk AS (SELECT e, greatest(len(list_filter(e, lambda c: c < score)), 1) AS bucket, COUNT(*) AS n, SUM(label) AS bad "
    "FROM scored, q GROUP BY ALL)"))
def score_ks_table(spark, folder):
    return rounded(evaluate.score_ks_table(scored(spark, folder, ["label"])))


LIFT_PARTS = (
    SCORED, "q AS (SELECT target, list_sort(list_distinct(quantile_cont(score, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]))) AS e FROM scored GROUP BY target)",
    "bk AS (SELECT target, e, greatest(len(list_filter(e, lambda c: c < score)), 1) AS bucket, COUNT(*) AS n, SUM(label) AS bad "
    "FROM scored JOIN q USING (target) GROUP BY ALL)",
    "kt AS (SELECT target, bucket, e[bucket] AS min, e[bucket + 1] AS max, bad / n AS bad_rate, n / SUM(n) OVER p AS total_prop, "
    "SUM(bad) OVER o / SUM(n) OVER o AS cum_bad_rate, SUM(n) OVER o / SUM(n) OVER p AS cum_total_prop FROM bk "
    "WINDOW p AS (PARTITION BY target), o AS (PARTITION BY target ORDER BY bucket ROWS UNBOUNDED PRECEDING))")


@query("lift_table", on_app(
    "SELECT CAST(bucket AS INT) AS bucket, " + ", ".join(
        f"round(max(CASE WHEN target = '{s}' THEN {c} END), 6) AS {s}_{c}" for s in ("train", "valid", "oot")
        for c in evaluate.LIFT_COLUMNS) + " FROM kt GROUP BY bucket", *LIFT_PARTS))
def lift_table(spark, folder):
    return rounded(evaluate.lift_table(scored(spark, folder, ["label", "target"])))


def lift_select(group):
    return (f"SELECT {group} AS datasets, " + ", ".join(
        f"CASE WHEN avg(label) > 0 THEN avg(label) FILTER (proba >= t{n}) / avg(label) ELSE 0 END AS top_{n}_lift"
        for n in evaluate.TOP_PERCENTS) + " FROM app JOIN (SELECT " + group + " AS k, " + ", ".join(
        f"quantile_cont(proba, {1 - n / 100}) AS t{n}" for n in evaluate.TOP_PERCENTS)
        + f" FROM app GROUP BY {group}) ON {group} = k GROUP BY {group}")


LIFTS = f"lifts AS ({lift_select('target')} UNION ALL {lift_select('month_time')})"
LIFT_NAMES = [f"top_{n}_lift" for n in evaluate.TOP_PERCENTS]


@query("top_lift", on_app("SELECT datasets, " + r6(*LIFT_NAMES) + " FROM lifts WHERE datasets IN ('train', 'valid', 'oot')", LIFTS))
def top_lift(spark, folder):
    return rounded(evaluate.top_lift(kept_applications(spark, folder, ["proba", "label", "target"]), "target"))


@query("performance_table", on_app(
    "SELECT datasets, round(auc, 6) AS auc, round(ks, 6) AS ks, " + r6(*LIFT_NAMES) + " FROM ranked LEFT JOIN lifts USING (datasets)",
    *PERFORMANCE_PARTS, LIFTS))
def performance_table(spark, folder):
    return rounded(evaluate.performance_table(kept_applications(spark, folder, ["proba", "label", "target", "month_time"])))


@query("data_summary", on_app(" UNION ALL ".join(
    f"SELECT '{section}' AS section, {name} AS dataset, COUNT(label) AS count, round(avg(label), 6) AS badrate, "
    "round(SUM(label * weight) / SUM(weight), 6) AS badrate_weight, min(month_time) AS month_min, max(month_time) AS month_max "
    f"FROM app {group}" for section, name, group in (
        ("all", "'all'", ""), ("split", "target", "GROUP BY target"), ("month", "month_time", "GROUP BY month_time")))))
def data_summary(spark, folder):
    return rounded(evaluate.data_summary(applications(spark, folder, ["label", "target", "month_time", "weight"])))


# ---------------------------------------------------------------- monitoring figures

@query("stability_bands", on_app(
    "SELECT feature, CASE WHEN psi_to < 0.1 THEN 'stable' WHEN psi_to > 0.25 THEN 'unstable' ELSE 'attention' END AS band FROM pp",
    long_part(), *PAIRWISE_PARTS))
def stability_bands(spark, folder):
    metrics = psi.pairwise_psi(kept_applications(spark, folder, [*FEATURES, "target"]), FEATURES)
    return metrics.select("feature", psi.stability_band("psi_to").alias("band"))


@query("psi_stored_distribution", on_app(
    """SELECT round(SUM((ap - xp) * ln(ap / xp)), 6) AS psi, CAST(SUM(a) AS BIGINT) AS n FROM (
      SELECT a, CASE WHEN x = 0 THEN 1e-6 ELSE x / SUM(x) OVER () END AS xp, CASE WHEN a = 0 THEN 1e-6 ELSE a / SUM(a) OVER () END AS ap
      FROM (SELECT b, COUNT(*) FILTER (target = 'train') AS x, COUNT(*) FILTER (target = 'oot') AS a
        FROM (SELECT unnest(range(1, 21)) AS b) LEFT JOIN (SELECT target, greatest(least(len(list_filter(range(0, 21), lambda i:
          (CASE WHEN i = 20 THEN hi ELSE i * ((hi - lo) / 20) + lo END) <= score)), 20), 1) AS bin FROM scored, ends) ON bin = b GROUP BY b))""",
    SCORED, "ends AS (SELECT min(score) AS lo, max(score) AS hi FROM scored WHERE target = 'train')"))
def psi_stored_distribution(spark, folder):
    app = scored(spark, folder, ["label", "target"])
    stored = evaluate.score_distribution(app.where(F.col("target") == "train")).first()
    return rounded(psi.psi_from_distribution(app.where(F.col("target") == "oot"), "score", stored.asDict()))


@query("numeric_columns", on_app("SELECT app_id, apply_month, amount FROM app"))
def narrow_numeric(spark, folder):
    app = applications(spark, folder, ["app_id", "apply_month", "amount", "segment", "apply_time"])
    return app.select(*numeric_columns(app, narrow=True))
