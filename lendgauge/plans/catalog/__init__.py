"""The registered queries, by subject."""

from . import bins, decisions, history, mined, models, sinks, tables  # noqa: F401
from .registry import QUERIES, STATEMENTS

__all__ = ["QUERIES", "STATEMENTS"]
