"""Fitting scorecard models with a seeded parameter search whose trials run side by side."""

import json
import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guards import is_numeric
from ..session import checkpointed
from ..sources.models import ScorecardModel
from . import boosting, tpe
from .clean import category_codes, feature_list, with_weight
from .evaluate import ks_auc, score_distribution
from .scoring import MANUAL_SCALE, auto_scale, with_score

# Search ranges per model type; ``log`` draws are uniform in the logarithm.
SPACES = {
    "lr": {"C": ("log", 0.01, 1.0), "maxIter": ("log_int", 100, 5000)},
    "xgb": {"reg_lambda": ("log", 1e-8, 500.0), "reg_alpha": ("log", 1e-8, 1.0), "n_estimators": ("log_int", 30, 400), "max_depth": ("int", 1, None),
            "min_child_weight": ("log_int", 1, 50), "learning_rate": ("log", 0.01, 0.3), "colsample_bytree": ("log", 0.1, 1.0),
            "scale_pos_weight": ("log", 1.0, 50.0), "gamma": ("log", 1e-8, 1.0), "subsample": ("log", 0.5, 1.0)},
    "lgb": {"learning_rate": ("log", 0.01, 0.3), "n_estimators": ("log_int", 10, 500), "max_depth": ("int", 2, None), "num_leaves": ("int", 8, 64),
            "min_child_weight": ("log", 1e-3, 10.0), "reg_lambda": ("log", 1e-8, 500.0), "reg_alpha": ("log", 1e-8, 500.0),
            "colsample_bytree": ("log", 0.1, 1.0), "subsample": ("log", 0.3, 1.0)},
    "rf": {"numTrees": ("log_int", 20, 200), "maxDepth": ("int", 1, None), "minInstancesPerNode": ("log_int", 1, 50)},
    "dt": {"maxDepth": ("int", 1, None), "minInstancesPerNode": ("log_int", 1, 50)},
}
#: Other types are fitted as boosted trees.
OWN_FITS = ("lr", "rf", "dt")
#: Trials fitted side by side.
PARALLEL = 4
#: Bytes of bagged rows of a forest that a partition should hold; each row has a number per tree.
BAGGED_BYTES = 256 << 20
#: Rows of a partition when the rows of a search are gathered in as few as there are cores.
SEARCH_ROWS = 500_000
#: Bytes of train rows that the fits of a search keep at the same time; a single fit may keep more.
SEARCH_BYTES = 2 << 30


def search_space(model_type, max_depth=6, space=None):
    """Ranges of a model type with ``max_depth`` as the open upper ends; an unknown type has those of boosted trees."""
    ranges = space or SPACES.get(model_type, SPACES["xgb"])
    return {n: (kind, low, max(low, max_depth) if high is None else high) for n, (kind, low, high) in ranges.items()}


def make_classifier(model_type, params, n_rows, seed=42, **columns):
    """Unfitted Spark ML estimator of a regression, a forest or a tree.

    Single trees and forests predict the bad rate of their leaves: on a 0/1 label the variance ranks
    splits as Gini does, while classification trees would merge leaves that predict the same class.
    """
    settings = {k: v for k, v in params.items() if k != "C"}
    if model_type == "lr":
        # The penalty of the usual C is spread over the rows.
        strength = 1.0 / (params["C"] * max(n_rows, 1)) if "C" in params else 0.0
        return LogisticRegression(regParam=strength, elasticNetParam=0.0, **settings, **columns)
    if model_type == "dt":
        return DecisionTreeRegressor(seed=seed, **settings, **columns)
    settings.setdefault("featureSubsetStrategy", "sqrt")
    return RandomForestRegressor(seed=seed, **settings, **columns)


def dealt_for_forest(rows: DataFrame, n_trees, width, bagged_bytes=BAGGED_BYTES):
    """``rows``, spread over as many partitions as keep ``bagged_bytes`` in a forest of ``n_trees`` if one per core would not."""
    parts = math.ceil(rows.count() * (8 * n_trees + 8 * width + 100) / bagged_bytes)
    return rows.repartition(parts) if parts > rows.sparkSession.sparkContext.defaultParallelism else rows


def numeric_label(df: DataFrame, label):
    """The label as a number; two text values become 0 and 1 in alphabetical order."""
    if is_numeric(df.schema[label].dataType):
        return df
    found = sorted(r[0] for r in df.select(F.col(label).cast("string")).where(F.col(label).isNotNull()).distinct().limit(3).collect())
    if len(found) > 2:
        raise ValueError(f"the label {label} has more than two values")
    value = F.col(label).cast("string")
    return df.withColumn(label, F.when(value == found[-1], 1 if len(found) == 2 else 0).when(value.isNotNull(), 0))


def class_sizes(train: DataFrame, label):
    """Rows of label 0 and of label 1."""
    n = train.agg(F.count_if(F.col(label) == 0).alias("good"), F.count_if(F.col(label) == 1).alias("bad")).first()
    return n["good"], n["bad"]


def training_weight(train: DataFrame, label, weight, balanced=False, positive=1.0, sizes=None):
    """Row weight times class weight: ``n / (2 * n_class)`` when balanced, ``positive`` for bads."""
    w = F.col(weight).cast("double")
    if not balanced:
        return w * F.when(F.col(label) == 1, positive).otherwise(1.0)
    good, bad = sizes or class_sizes(train, label)
    total = good + bad
    return w * F.when(F.col(label) == 1, total / (2 * max(bad, 1))).otherwise(total / (2 * max(good, 1)))


def shell_model(train, features, texts, codes, label, model_type, params=None):
    """A model to be fitted. Boosted trees see missing values as such, others a constant in their place."""
    shell = ScorecardModel(None, list(features), texts, codes, label, model_type, params=params or {})
    if model_type not in OWN_FITS:
        shell.fill_value = None
    return shell


def fit_model(train: DataFrame, features, label="label", model_type="lr", params=None, weight="weight", seed=42,
              codes=None, prepared=None, sizes=None) -> ScorecardModel:
    """Fit one model on rows with a label. Category codes are learned here and kept with the model.

    ``prepared`` rows, ``codes`` and class ``sizes`` may be handed in by a caller that fits several models on the same rows.
    """
    params = dict(params or {})
    texts = [c for c in features if not is_numeric(train.schema[c].dataType)]
    if texts and codes is None:
        codes = checkpointed(category_codes(train, texts))
    shell = shell_model(train, features, texts, codes, label, model_type, params)
    rows = prepared if prepared is not None else shell.prepared(with_weight(train, weight)).where(F.col(label).isNotNull())
    inputs = [f"_x{n}" for n in range(len(features))]
    if model_type == "lr" and sizes is None:
        sizes = class_sizes(rows, label)
    rows = rows.withColumn("_w", training_weight(rows, label, weight, model_type == "lr", params.get("scale_pos_weight", 1.0), sizes))
    if model_type not in OWN_FITS:
        settings = {k: v for k, v in params.items() if k != "scale_pos_weight"}
        shell.pipeline = boosting.fit(rows, inputs, label, "_w", params=settings, seed=seed, leaf_wise_growth=model_type == "lgb")
        return shell
    if model_type == "rf":
        rows = dealt_for_forest(rows.select(*inputs, label, "_w"), params.get("numTrees", 20), len(inputs))
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    classifier = make_classifier(model_type, params, sum(sizes or (1, 0)), seed, featuresCol="features", labelCol="_y", weightCol="_w")
    shell.pipeline = Pipeline(stages=[assembler, classifier]).fit(rows.withColumn("_y", F.col(label).cast("double")))
    return shell


def set_metrics(model: ScorecardModel, df: DataFrame, target="target", weight="weight", prepared=False, plain=False, sets=None):
    """``{set}_ks`` and ``{set}_auc`` of a model from one scoring pass. Rows may be ``prepared``, ``plain`` (without NaN) and the ``sets`` known."""
    scored = with_weight(model.probabilities(df, prepared=prepared, plain=plain), weight)
    metrics = {}
    for r in ks_auc(scored, [target], "proba", model.label, weight, groups=sets).collect():
        metrics[f"{r[target]}_ks"], metrics[f"{r[target]}_auc"] = r["ks"], r["auc"]
    return metrics


TRIALS = T.StructType([
    T.StructField("trial", T.IntegerType()), T.StructField("params", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()))])


def search(df: DataFrame, features, label="label", target="target", model_type="lr", n_trials=100, max_depth=6,
           strategy_type=1, threshold=0.03, weight="weight", seed=42, space=None, parallel=PARALLEL):
    """(best model, trial table). The trial with the highest oot KS wins, the first on ties; parameters follow the objective.

    ``parallel`` trials are drawn from those before them and fitted at the same time, each in a pool of its own, which share the cluster
    evenly where ``spark.scheduler.mode`` is FAIR. Draws depend on the seed and the trials before, never on which fit ends first. Rows are
    prepared once and kept for all trials. A fit keeps its train rows too: of many rows, fewer trials than drawn together are fitted at a time.
    """
    df = with_weight(numeric_label(df, label), weight)
    train = df.where(F.col(target) == "train")
    texts = [c for c in features if not is_numeric(df.schema[c].dataType)]
    codes = checkpointed(category_codes(train, texts)) if texts else None
    shell = shell_model(train, features, texts, codes, label, model_type)
    ranges = search_space(model_type, max_depth, space)
    spark = df.sparkSession
    ready = shell.prepared(df.select(*sorted({*features, label, target, weight})))
    ready = ready.select(*[f"_x{n}" for n in range(len(features))], *[F.col(f"`{c}`") for c in dict.fromkeys((label, target, weight))])
    # A fit passes over the rows many times: tasks of few rows would be most of its time.
    sizes = {r[target]: r["count"] for r in df.groupBy(target).count().collect()}
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(sum(sizes.values()) / SEARCH_ROWS))
    ready = ready.coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    prepared = ready.where((F.col(target) == "train") & F.col(label).isNotNull())
    sets, fitted = [(s,) for s in sizes], 8 * (len(features) + 2) * sizes.get("train", 0)
    waves = math.ceil(parallel / max(1, SEARCH_BYTES // max(fitted, 1)))
    together = math.ceil(parallel / max(1, waves)) or 1
    trials, history, best, best_ks = [], [], None, -math.inf

    def run(job):
        number, params = job
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{number % parallel}")
        model = fit_model(train, features, label, model_type, params, weight, seed, codes, prepared, classes)
        model.metrics = set_metrics(model, ready, target, weight, True, plain, sets)
        return number, params, model

    try:
        classes = class_sizes(prepared, label)
        # Spark ML refuses rows with NaN; without any, a regression is one expression.
        plain = ready.where(reduce(lambda a, b: a | b, [F.isnan(f"_x{n}") for n in range(len(features))])).isEmpty()
        with ThreadPoolExecutor(together) as pool:
            for first in range(0, n_trials, max(1, parallel)):
                numbers = range(first, min(first + max(1, parallel), n_trials))
                jobs = [(n, tpe.draw(ranges, history, n, seed)) for n in numbers]
                done = [(n, {k: float(v) for k, v in params.items()}, model) for n, params, model in pool.map(inheritable_thread_target(spark)(run), jobs)]
                rows = [(n, params, model.metrics) for n, params, model in done]
                trials += rows
                rated = spark.createDataFrame(rows, TRIALS).select("trial", objective_of_maps("metrics", strategy_type, threshold).alias("value")).collect()
                values = {r["trial"]: r["value"] for r in rated}
                history += [(params, values[n]) for n, params, _ in rows]
                for _, _, model in done:
                    if model.metrics.get("oot_ks", 0.0) > best_ks:
                        best, best_ks = model, model.metrics.get("oot_ks", 0.0)
    finally:
        ready.unpersist()
    table = spark.createDataFrame(trials, TRIALS)
    return best, table.withColumn("value", objective_of_maps("metrics", strategy_type, threshold))


def train_scorecard(df: DataFrame, features=None, label="label", target="target", model_type="lr", n_trials=100,
                    score_config=None, exclude=(), oot_col=None, weight="weight", **options):
    """Search, choose the score scale and store the score distribution of all rows with the model."""
    features = features or feature_list(df, exclude, label, oot_col, target, weight)
    df = numeric_label(df, label)
    model, trials = search(df, features, label, target, model_type, n_trials, weight=weight, **options)
    config = dict(score_config or MANUAL_SCALE)
    scored = model.probabilities(df.select(*sorted({*features, label})))
    if config.get("mode") == "auto":
        config.update(auto_scale(scored, "proba", config.get("min_score", 300), config.get("max_score", 900)))
    model.score_config = config
    row = score_distribution(with_score(scored, "proba", config), "score", label).first()
    model.score_distribution = json.loads(json.dumps(row.asDict(recursive=True)))
    return model, trials


# ---------------------------------------------------------------- objectives

# Objective numbers and the alignment limits they use (None is the caller's limit).
ALIGNED_KS = {3: None, 4: 0.02, 5: 0.04, 1348: 0.05, 1349: 0.03, 1350: 0.02}


def objective(strategy_type, threshold=0.03, train_ks="train_ks", valid_ks="valid_ks", oot_ks="oot_ks",
              train_auc="train_auc", valid_auc="valid_auc", oot_auc="oot_auc", oot_top_5_lift="oot_top_5_lift"):
    """Objective as a Column. Missing train and valid figures count 0, missing oot ones equal valid."""
    def column(c):
        return c if not isinstance(c, str) else F.col(c)

    zero = F.lit(0.0)
    kind = int(strategy_type)
    on_auc = 20 <= kind <= 27
    t = F.coalesce(column(train_auc if on_auc else train_ks), zero)
    v = F.coalesce(column(valid_auc if on_auc else valid_ks), zero)
    o = F.coalesce(column(oot_auc if on_auc else oot_ks), v)
    to, tv, vo = F.abs(t - o), F.abs(t - v), F.abs(v - o)
    penalty = -(to + tv)
    if kind == 1:
        return o - 0.2 * to - 0.2 * vo
    if kind == 2:
        return t - 0.2 * to
    if kind in ALIGNED_KS or kind == 26:
        limit = ALIGNED_KS.get(kind) or threshold
        return F.when((to < limit) & (tv < limit) & (vo < limit), o).otherwise(penalty)
    if kind == 6:
        return F.when((to < 0.3) & (tv < 0.1), o).otherwise(penalty)
    if kind == 10:
        return F.when((tv < 0.1) & (to < 0.1), (v + o) / 2).otherwise(penalty)
    if kind in (11, 12):
        return F.when(tv < threshold, v).otherwise(-tv)
    if kind == 20:
        return F.when(tv < 0.02, v).otherwise(-tv)
    if kind == 201:
        lift = F.coalesce(column(oot_top_5_lift), zero)
        return F.when((tv < 0.1) & (to < 0.1), (v + o) * 0.9 + lift * 0.1).otherwise(penalty)
    return v


def objective_of_maps(metrics, strategy_type, threshold=0.03):
    names = ("train_ks", "valid_ks", "oot_ks", "train_auc", "valid_auc", "oot_auc", "oot_top_5_lift")
    return objective(strategy_type, threshold, **{n: F.try_element_at(F.col(metrics), F.lit(n)) for n in names})


def best_trial(trials: DataFrame, oot_ks="oot_ks", trial="trial") -> DataFrame:
    """The trial with the highest oot KS; the first one on ties (top-1 report)."""
    return trials.orderBy(F.coalesce(F.col(oot_ks), F.lit(0.0)).desc(), trial).limit(1)


def feature_importance(model: ScorecardModel) -> DataFrame:
    """(feature, importance): split importance of trees, absolute coefficient of a regression."""
    if model.model_type == "lr":
        values = [abs(float(v)) for v in model.pipeline.stages[-1].coefficients]
    elif isinstance(model.pipeline, boosting.BoostedTrees):
        values = [float(v) for v in model.pipeline.importances()]
    else:
        values = [float(v) for v in model.pipeline.stages[-1].featureImportances.toArray()]
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(list(zip(model.features, values)), "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def importance_table(model: ScorecardModel, iv: DataFrame, ks: DataFrame) -> DataFrame:
    """Importance beside IV and KS per split."""
    return feature_importance(model).join(iv, "feature", "left").join(ks, "feature", "left").orderBy(
        F.desc("importance"), "feature")
