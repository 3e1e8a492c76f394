"""Feature screening: quality, information value, stability and correlation."""


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.guards import is_numeric, numeric_columns
from .profile import top_share
from .woe import multi_set_metrics


#: Of the sketch that proposes a median. Its error is far below what a dominating value has beyond one half; finer ones are slow to merge.
MEDIAN_ACCURACY = 1000

VERDICT = ("column_name string, missing_rate double, std double, kept boolean, reason string")


def screen_basic(df: DataFrame, columns, freq_limit=0.95, missing_limit=0.95, impute_value=None) -> DataFrame:
    """First-layer verdicts in the order missing rate, top-value share, zero deviation.

    A value with more than half of all values covers the median, so the only candidate is the
    median from a sketch (of the value's hash for text); a second pass counts it exactly. Two scans
    and no shuffle of values. Limits near or below one half take full value counts instead.
    """
    columns = list(columns)
    kinds = {c: df.schema[c].dataType for c in columns}
    majority = freq_limit > 0.5 + 10 / MEDIAN_ACCURACY
    first = []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`")
        absent = v.isNull()
        if impute_value is not None and is_numeric(kinds[c]):
            absent = absent | (v == F.lit(impute_value))
        first += [F.count_if(absent).alias(f"missing{i}"), F.count(v).alias(f"n{i}")]
        if is_numeric(kinds[c]):
            first.append(F.stddev_samp(v).alias(f"std{i}"))
        if majority:
            first.append(F.percentile_approx(_ranked(v, kinds[c]), 0.5, MEDIAN_ACCURACY).alias(f"mid{i}"))
    seen = df.agg(F.count("*").alias("rows"), *first).first()
    rows = seen["rows"]

    shares = {}
    if majority:
        second = []
        for i, c in enumerate(columns):
            if seen[f"mid{i}"] is None:
                continue
            v = F.col(f"`{c}`")
            same = _ranked(v, kinds[c]) == F.lit(seen[f"mid{i}"])
            second.append(F.count_if(same).alias(f"top{i}"))
            if not is_numeric(kinds[c]):
                text = F.when(same, v.cast("string"))
                second.append((F.min(text) == F.max(text)).alias(f"one{i}"))
        counted = df.agg(*second).first() if second else None
        clashing = []
        for i, c in enumerate(columns):
            if seen[f"mid{i}"] is None:
                continue
            if not is_numeric(kinds[c]) and not counted[f"one{i}"]:
                clashing.append(c)
            else:
                shares[c] = counted[f"top{i}"] / seen[f"n{i}"]
    else:
        clashing = columns
    if clashing:
        shares.update({r["column_name"]: r["top_share"] for r in top_share(df, clashing).collect()})

    verdicts = []
    for i, c in enumerate(columns):
        std = seen[f"std{i}"] if is_numeric(kinds[c]) else None
        missing = seen[f"missing{i}"] / rows if rows else None
        if not rows:
            reason = None
        elif missing >= missing_limit:
            reason = "missing"
        elif c in shares and shares[c] >= freq_limit:
            reason = "freq"
        elif std == 0:
            reason = "zero_std"
        else:
            reason = None
        verdicts.append((c, missing, std, reason is None, reason))
    return df.sparkSession.createDataFrame(verdicts, VERDICT)


def _ranked(value, kind):
    """The value itself for numbers, a hash for everything else; null stays null.

    The sketch holds doubles, so the hash has 52 bits: a longer one would come back as another number.
    """
    return value if is_numeric(kind) else F.when(value.isNotNull(), F.shiftrightunsigned(F.xxhash64(value.cast("string")), 12))


# ---------------------------------------------------------------- correlation

#: Pairs whose sums (48 bytes a pair) a task holds at a time; wider tables are counted in as many strips as that takes.
PAIR_SUMS = 1 << 22
#: Values of a slice of rows that is multiplied at a time.
SLICE_VALUES = 1 << 20
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def correlation_pairs(df: DataFrame, columns=None, pair_sums=PAIR_SUMS) -> DataFrame:
    """(feature_a, feature_b, corr) for all a < b in column order, over rows where both are present.

    NaN counts as missing. Sums are taken around the column means; pairs without common rows or without variation give null.
    Up to 2048 columns take two scans. More are counted in strips of the matrix of pairs, each a scan of the columns it needs, so
    that no task holds more than ``pair_sums`` pairs (or those of one column).
    """
    columns = list(columns or numeric_columns(df, narrow=True))
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, corr double")
    values = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in columns]
    width = len(columns)
    centres = _means(df.select(F.array(*values)), width)
    every = df.sparkSession.range(width - 1).select(
        F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.col("id") + 1, F.lit(width - 1).cast("bigint"))).alias("j"))
    sums = every.select("i", F.col("j").cast("int").alias("j"), *[F.lit(0.0).alias(s) for s in SUMS])
    for first, end in _strips(width, pair_sums):
        sums = sums.unionByName(_pair_sums(df.select(F.array(*values[first:])), centres[first:], first, end))
    sums = sums.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), F.col("n"))
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("n"))
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    named = F.array(*[F.lit(c) for c in columns])
    return sums.select(
        F.get(named, F.col("i")).alias("feature_a"), F.get(named, F.col("j")).alias("feature_b"),
        F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("corr"))


def _strips(width, pair_sums):
    """Ranges of first features of pairs: a range times the features from its start on is at most ``pair_sums``, or one feature."""
    first = 0
    while first < width - 1:
        end = min(width - 1, first + max(1, pair_sums // (width - first)))
        yield first, end
        first = end


def _slices(batches, width):
    """Rows of an array column of ``width`` numbers as matrices of at most ``SLICE_VALUES`` numbers (or one row)."""
    for batch in batches:
        rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        step = max(1, SLICE_VALUES // width)
        for at in range(0, len(rows), step):
            yield rows[at:at + step]


def _few_tasks(df):
    """Input partitions joined, without a shuffle, to one task per core: every task sends its sums for all pairs."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, 1))


def _means(values, width):
    """Mean of each place of an array column, NaN left out; 0 where nothing is left."""
    def partial(batches):
        count, total = np.zeros(width), np.zeros(width)
        for x in _slices(batches, width):
            known = ~np.isnan(x)
            count, total = count + known.sum(axis=0), total + np.where(known, x, 0.0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(count), pa.array(total)], names=["i", "n", "s"])

    found = _few_tasks(values).mapInArrow(partial, "i int, n double, s double").groupBy("i").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean"))
    centres = np.zeros(width)
    # One row per feature.
    for r in found.collect():
        centres[r["i"]] = r["mean"] or 0.0
    return centres


def _pair_sums(values, centre, first, end):
    """Sums of the pairs whose first feature is in ``[first, end)``; ``values`` and ``centre`` start at feature ``first``.

    Per task one set of matrix products; the shuffle carries pairs, never rows.
    """
    width, height = len(centre), end - first

    def partial(batches):
        total = None
        for rows in _slices(batches, width):
            x = rows - centre
            known = ~np.isnan(x)
            x, m = np.where(known, x, 0.0), known.astype(float)
            xs, ms, squares = x[:, :height].T, m[:, :height].T, x * x
            found = [ms @ m, xs @ m, ms @ x, squares[:, :height].T @ m, ms @ squares, xs @ x]
            if total is None:
                total = found
            else:
                for t, f in zip(total, found):
                    t += f
        for i in range(height if total is not None else 0):
            j = np.arange(i + 1, width, dtype=np.int32) + np.int32(first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(j), first + i, np.int32)), pa.array(j), *[pa.array(t[i, i + 1:]) for t in total]], names=["i", "j", *SUMS])

    return _few_tasks(values).mapInArrow(partial, "i int, j int, " + ", ".join(f"{s} double" for s in SUMS))


def correlation_prune(pairs: DataFrame, iv: DataFrame, limit=0.9) -> DataFrame:
    """(feature) to drop: of every pair at or above the limit the one with the lower IV, on ties the
    second. Features dropped by one pair still count in others.

    IVs are compared to ten digits, so that equal ones tie whatever order they were summed in.
    """
    table = F.broadcast(iv.select(F.col("feature"), F.round("iv", 10).alias("iv")))
    a = table.select(F.col("feature").alias("feature_a"), F.col("iv").alias("_iv_a"))
    b = table.select(F.col("feature").alias("feature_b"), F.col("iv").alias("_iv_b"))
    close = pairs.where(F.abs("corr") >= limit).join(a, "feature_a", "left").join(b, "feature_b", "left")
    first_stays = F.coalesce("_iv_a", F.lit(0.0)) >= F.coalesce("_iv_b", F.lit(0.0))
    return close.select(
        F.when(first_stays, F.col("feature_b")).otherwise(F.col("feature_a")).alias("feature")).distinct()


# ---------------------------------------------------------------- layered filter

def iv_screen(metrics: DataFrame, limit=0.02) -> DataFrame:
    """Features whose train IV is below the limit."""
    return metrics.where(F.col("iv_train") < limit).select("feature", F.col("iv_train").alias("iv"))


def psi_screen(metrics: DataFrame, limit=0.1) -> DataFrame:
    """Features whose train-valid or train-oot PSI is above the limit."""
    return metrics.where((F.col("psi_tv") > limit) | (F.col("psi_to") > limit)).select("feature", "psi_tv", "psi_to")


def filter_features(df: DataFrame, columns, label="label", target="target", freq=0.95, missing=0.95, iv=0.02,
                    psi=0.1, corr=0.9, skip_basic=False, impute_value=None, iv_method="simple") -> DataFrame:
    """(feature, position, kept, reason, iv_train): both layers, the first failing one as the reason.

    Quality, IV and correlation are judged on the train rows.
    """
    columns = list(columns)
    train = df.where(F.col(target) == "train")
    reasons = {}
    if not skip_basic:
        verdicts = screen_basic(train, columns, freq, missing, impute_value).collect()
        reasons = {r["column_name"]: r["reason"] for r in verdicts if r["reason"]}
    open_columns = [c for c in columns if c not in reasons]
    if open_columns:
        metrics = multi_set_metrics(df, open_columns, label, target, iv_method=iv_method).collect()
    else:
        metrics = []
    ivs = {m["feature"]: m["iv_train"] for m in metrics}
    # One row per feature from here on.
    for m in metrics:
        if m["iv_train"] < iv:
            reasons[m["feature"]] = "iv"
        elif max(m["psi_tv"], m["psi_to"]) > psi:
            reasons[m["feature"]] = "psi"
    numeric = [c for c in open_columns if c not in reasons and is_numeric(df.schema[c].dataType)]
    if len(numeric) > 1:
        known = df.sparkSession.createDataFrame([(c, float(ivs.get(c, 0.0))) for c in numeric], "feature string, iv double")
        dropped = correlation_prune(correlation_pairs(train, numeric), known, corr)
        reasons.update({r["feature"]: "corr" for r in dropped.collect()})
    return df.sparkSession.createDataFrame(
        [(c, i, c not in reasons, reasons.get(c), ivs.get(c)) for i, c in enumerate(columns)],
        "feature string, position int, kept boolean, reason string, iv_train double")


def filter_summary(verdicts: DataFrame) -> DataFrame:
    """One row: features in, kept, dropped, and dropped per reason."""
    return verdicts.agg(
        F.count("*").alias("total_input"), F.count_if("kept").alias("total_kept"),
        F.count_if(~F.col("kept")).alias("total_dropped"),
        *[F.count_if(F.col("reason") == r).alias(f"drop_by_{r}")
          for r in ("missing", "freq", "zero_std", "iv", "psi", "corr")])


def top_features(metrics: DataFrame, n=10, floor=0.01) -> DataFrame:
    """The features with the highest train IV among those at or above the floor (top-k report)."""
    return metrics.where(F.col("iv_train") >= floor).select(
        "feature", F.round("iv_train", 4).alias("iv_train"), F.round("psi_tv", 4).alias("psi_tv"),
        F.round("psi_to", 4).alias("psi_to")).orderBy(F.desc("iv_train"), "feature").limit(n)
