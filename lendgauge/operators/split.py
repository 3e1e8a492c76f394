"""Train, valid and out-of-time tags from exact rank boundaries.

No split sorts the table: the boundary row is found by exact rank selection, then every row is
compared with it.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.periods import parse_time
from .ranks import SMALL_GROUP, order_statistics

DEFAULT_OOT_SHARE = 0.2


def stable_draw(key, seed=42):
    """Whole number below 2**52 that depends on the key and the seed only."""
    text = F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def default_oot_share(ratios=None):
    """Last of three or more ratios over their sum, else 0.2."""
    return ratios[-1] / sum(ratios) if ratios and len(ratios) >= 3 else DEFAULT_OOT_SHARE


def _tie(df: DataFrame, key):
    """What orders rows of one time: a numeric key itself, a hash of any other."""
    kind = df.schema[key].dataType
    ordered = isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))
    return F.col(key) if ordered else F.xxhash64(F.col(key).cast("string"))


def _rank_cut(df: DataFrame, order, tie, rank, n, small_group):
    """(order, tie) of the row at ``rank`` of the ``n`` timed rows sorted by both; None outside of them."""
    if rank >= n or rank < 0:
        return None
    present = df.where(F.col(order).isNotNull()).select(order, tie)
    at = order_statistics(present, order, {(): [rank]}, (), small_group, sizes={(): n})[()][rank]
    below, equal = present.agg(
        F.count_if(F.col(order) < F.lit(at)), F.count_if(F.col(order) == F.lit(at))).first()
    inner = rank - below
    ties = present.where(F.col(order) == F.lit(at))
    return at, order_statistics(ties, tie, {(): [inner]}, (), small_group, sizes={(): equal})[()][inner]


def _at_or_after(order, tie, cut):
    at, tie_value = cut
    later = F.col(order) > F.lit(at)
    return later | ((F.col(order) == F.lit(at)) & (F.col(tie) >= F.lit(tie_value)))


def tag_oot_by_share(df: DataFrame, time_col, key, share, tag="split", null_times="rest", small_group=SMALL_GROUP):
    """``oot`` for the last ``share`` of rows by time, ties ordered by ``key``; null for the rest.

    The boundary row is ``int(n * (1 - share))``. Rows without a readable time stay in the rest;
    ``null_times='oot'`` sorts them last instead. A key that isn't a number or a time orders ties by its hash.
    """
    timed = df.withColumn("_time", parse_time(df, time_col)).withColumn("_tie", _tie(df, key))
    n, present = timed.agg(F.count("*"), F.count("_time")).first()
    boundary = int(n * (1 - share))
    absent = F.col("_time").isNull()
    if null_times == "oot":
        cut = _rank_cut(timed, "_time", "_tie", boundary, present, small_group) if boundary < present else None
        if cut is None:
            nulls = timed.where(absent)
            inner = boundary - present
            found = order_statistics(nulls, "_tie", {(): [inner]}, (), small_group, sizes={(): n - present}) \
                if 0 <= inner < n - present else {(): {}}
            edge = found[()].get(inner)
            oot = F.lit(False) if edge is None else absent & (F.col("_tie") >= F.lit(edge))
        else:
            oot = F.coalesce(_at_or_after("_time", "_tie", cut), F.lit(True))
    else:
        cut = _rank_cut(timed, "_time", "_tie", max(boundary - (n - present), 0), present, small_group)
        oot = F.lit(False) if cut is None else F.coalesce(_at_or_after("_time", "_tie", cut), F.lit(False))
    return timed.withColumn(tag, F.when(oot, "oot")).drop("_time", "_tie")


def tag_oot_by_time(df: DataFrame, time_col, start, tag="split") -> DataFrame:
    """``oot`` for rows at or after ``start``; null for the rest."""
    time = parse_time(df, time_col)
    return df.withColumn(tag, F.when(time >= F.lit(start).cast("timestamp"), "oot"))


def stratified_tags(df: DataFrame, key, label, shares, names, seed=42, small_group=SMALL_GROUP, where=None, tag="split"):
    """Exact quotas per label value: rows ordered by a stable draw are cut at ``int(n * share)``.

    ``where`` restricts the split to some rows and leaves the tag of the others.
    """
    scope = F.lit(True) if where is None else where
    draw = stable_draw(key, seed)
    strata = F.coalesce(F.col(label).cast("string"), F.lit("")) if label in df.columns else F.lit("")
    drawn = df.withColumn("_draw", draw).withColumn("_stratum", strata)
    inside = drawn.where(scope)
    sizes = {(r["_stratum"],): r["n"] for r in inside.groupBy("_stratum").agg(F.count("*").alias("n")).collect()}
    total = sum(shares)
    wanted, cuts = {}, {}
    for stratum, n in sizes.items():
        passed = 0.0
        cuts[stratum] = []
        for share in shares[:-1]:
            passed += share / total
            cuts[stratum].append(int(n * passed))
        wanted[stratum] = sorted({c for c in cuts[stratum] if c < n})
    found = order_statistics(inside, "_draw", wanted, ["_stratum"], small_group, sizes=sizes)
    chosen = F.lit(names[-1])
    for stratum, ranks in cuts.items():
        own = F.lit(names[-1])
        for name, rank in reversed(list(zip(names, ranks))):
            edge = found[stratum].get(rank)
            own = F.lit(name) if edge is None else F.when(F.col("_draw") < F.lit(edge), name).otherwise(own)
        chosen = F.when(F.col("_stratum") == F.lit(stratum[0]), own).otherwise(chosen)
    kept = F.col(tag) if tag in df.columns else F.lit(None).cast("string")
    return drawn.withColumn(tag, F.when(scope, chosen).otherwise(kept)).drop("_draw", "_stratum")


def preset_tags(df: DataFrame, preset="target", tag="split"):
    """Lower-cased preset tags, or None when the column holds neither train nor valid.

    Rows already tagged ``oot`` keep their tag, and a preset ``oot`` among the rest is ignored (null)
    once a time-based part exists.
    """
    if preset not in df.columns:
        return None
    name = F.lower(F.col(preset).cast("string"))
    timed = F.col(tag) == "oot" if tag in df.columns else F.lit(False)
    timed = F.coalesce(timed, F.lit(False))
    usable, has_oot = df.agg(
        F.max(F.coalesce(~timed & name.isin("train", "valid"), F.lit(False))), F.max(timed)).first()
    if not usable:
        return None
    rest = F.when(name == "oot", None).otherwise(name) if has_oot else name
    return df.withColumn(tag, F.when(timed, "oot").otherwise(rest))


def split_dataset(df: DataFrame, key, label="label", ratios=None, oot_col=None, oot_start=None, oot_share=None,
                  preset="target", seed=42, tag="split", small_group=SMALL_GROUP) -> DataFrame:
    """One ``tag`` column with train, valid and oot.

    A time column takes the out-of-time part first (by share if given, else by start, else by the
    default share); a preset tag column decides the rest; otherwise a stratified draw does.
    """
    tagged = df.withColumn(tag, F.lit(None).cast("string"))
    timed = bool(oot_col and oot_col in df.columns)
    if timed:
        if not oot_share and not oot_start:
            oot_share = default_oot_share(ratios)
        if oot_share and oot_share > 0:
            tagged = tag_oot_by_share(df, oot_col, key, oot_share, tag, small_group=small_group)
        else:
            tagged = tag_oot_by_time(df, oot_col, oot_start, tag)
    given = preset_tags(tagged, preset, tag) if preset and preset != tag else None
    if given is not None:
        return given
    ratios = ratios or [0.8, 0.2]
    if timed:
        return stratified_tags(tagged, key, label, ratios[:2], ["train", "valid"], seed, small_group,
                               F.col(tag).isNull(), tag)
    names = ["train", "valid", "oot"][:min(len(ratios), 3)]
    return stratified_tags(tagged, key, label, ratios[:3], names, seed, small_group, None, tag)


def mining_split(df: DataFrame, key, time_col=None, share=0.7, seed=42, tag="target_group", small_group=SMALL_GROUP):
    """``train`` for the first ``int(share * n) + 1`` rows in time order, else for a random ``share``."""
    if not time_col or time_col not in df.columns:
        limit = int(share * 2 ** 52)
        return df.withColumn(tag, F.when(stable_draw(key, seed) < F.lit(limit), "train").otherwise("test"))
    timed = df.withColumn("_time", parse_time(df, time_col))
    n, present = timed.agg(F.count("*"), F.count("_time")).first()
    cut = _rank_cut(timed, "_time", key, int(n * share) + 1, present, small_group)
    # Rows without a time sort last, so they belong to the test part.
    later = F.lit(False) if cut is None else F.coalesce(_at_or_after("_time", key, cut), F.lit(True))
    return timed.withColumn(tag, F.when(later, "test").otherwise("train")).drop("_time")


def tag_union(parts, tag="target") -> DataFrame:
    """Separate parts under one tag column: ``{name: DataFrame}``."""
    tagged = [part.withColumn(tag, F.lit(name)) for name, part in parts.items()]
    result = tagged[0]
    for part in tagged[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result
