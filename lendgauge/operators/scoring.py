"""Scores from probabilities, automatic scaling and scoring with a saved model."""

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import probability_to_score, score_of

MANUAL_SCALE = {"mode": "manual", "base_score": 600, "pdo": 20, "base_odds": 50}

# Start, step sizes and limits of the automatic scaling.
AUTO_START = {"base_score": 600, "base_odds": 50, "pdo": 20}
PDO_STEP, BASE_STEP, HALVE_EVERY, STEP_LIMIT, NARROWEST = 5, 50, 50, 300, 0.6


def with_score(df: DataFrame, probability="proba", config=None, name="score") -> DataFrame:
    config = {**MANUAL_SCALE, **(config or {})}
    return df.withColumn(name, probability_to_score(
        F.col(probability), pdo=config["pdo"], base_odds=config["base_odds"], base_score=config["base_score"]))


def auto_scale(df: DataFrame, probability="proba", min_score=300, max_score=900):
    """Scale settings that spread the scores over most of ``[min_score, max_score]``.

    The score falls as the probability rises, so only the two extreme probabilities are needed. The spread follows from ``pdo``
    alone and is settled first, then the place from ``base_score``. ``converged`` tells whether the limits hold at the end; without
    any probability the start is returned, not converged.
    """
    ends = df.agg(F.min(probability).alias("low"), F.max(probability).alias("high")).first()
    odds, width = AUTO_START["base_odds"], max_score - min_score
    if ends["low"] is None:
        return {**{k: float(v) for k, v in AUTO_START.items()}, "converged": False}

    def extremes(pdo, base):
        return score_of(ends["high"], pdo, odds, base), score_of(ends["low"], pdo, odds, base)

    def spread(pdo):
        low, high = extremes(pdo, AUTO_START["base_score"])
        return int(high - low >= width) - int(high - low <= NARROWEST * width)

    pdo = settled(AUTO_START["pdo"], spread, PDO_STEP, least=1)

    def outside(base):
        low, high = extremes(pdo, base)
        return int(high > max_score) - int(low < min_score)

    base = settled(AUTO_START["base_score"], outside, BASE_STEP, least=0)
    low, high = extremes(pdo, base)
    return {"base_score": float(base), "base_odds": float(odds), "pdo": float(pdo),
            "converged": spread(pdo) == 0 and min_score <= low and high <= max_score}


def settled(start, side, step, least):
    """Where a setting rests that moves up where ``side`` is -1, down (to ``least`` at most) where it is 1, and not where it is 0.

    ``side`` never falls as the setting rises. So moves of one length needn't be made one by one: the first that leaves the side is
    found by bisection, and one that jumps over all resting places is followed by moves back and forth, of which only an odd one counts.
    """
    at = start
    for _ in range(0, STEP_LIMIT, HALVE_EVERY):
        here = side(at)
        if not here:
            break
        after = [max(least, at - here * step * k) for k in range(HALVE_EVERY + 1)]
        moves = bisect_left(after, True, key=lambda x: side(x) != here)
        at = after[min(moves, HALVE_EVERY)]
        if moves < HALVE_EVERY and side(at) == -here and (HALVE_EVERY - moves) % 2:
            at = max(least, at + here * step)
        step = max(1, step // 2)
    return at


def auto_scale_frame(df: DataFrame, probability="proba", min_score=300, max_score=900) -> DataFrame:
    config = auto_scale(df, probability, min_score, max_score)
    return df.sparkSession.createDataFrame(
        [(config["base_score"], config["base_odds"], config["pdo"], config["converged"])],
        "base_score double, base_odds double, pdo double, converged boolean")


def with_model_scores(df: DataFrame, rules, models) -> DataFrame:
    """Add ``_model_result_{id}`` for every scored field the rules use.

    ``models`` maps the id to a fitted model. Present columns, unknown ids and models whose features
    are not in the table are skipped.
    """
    prefix = "_model_result_"
    wanted = sorted({r.field for r in rules if r.field.startswith(prefix) and r.field[len(prefix):].isdigit()})
    for name in wanted:
        model = models.get(int(name[len(prefix):]))
        if name in df.columns or model is None or set(model.features) - set(df.columns):
            continue
        df = model.score(df, score_name=name, keep_probability=False)
    return df
