"""Probability of default to score points."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import clip

# Fixed value: probabilities are kept this far from 0 and 1.
PROBABILITY_MARGIN = 1e-6


def probability_to_score(probability, pdo=30, rate=2, base_odds=35, base_score=750) -> Column:
    """Points rise by ``pdo`` whenever the good:bad odds grow by ``rate``; ``base_odds`` is worth
    ``base_score``."""
    p = clip(probability, PROBABILITY_MARGIN, 1 - PROBABILITY_MARGIN)
    factor = pdo / math.log(rate)
    return F.lit(base_score - factor * math.log(base_odds)) + F.lit(factor) * (F.ln(1 - p) - F.ln(p))


def score_of(probability, pdo=20, base_odds=50, base_score=600, rate=2):
    """The same mapping for one number."""
    p = min(max(probability, PROBABILITY_MARGIN), 1 - PROBABILITY_MARGIN)
    factor = pdo / math.log(rate)
    return base_score - factor * math.log(base_odds) + factor * math.log((1 - p) / p)
