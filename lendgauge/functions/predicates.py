"""Rules over applications compiled to boolean Columns.

A rule is ``field op value``. It compares numbers when the value reads as a number and the column
holds at least one number, and text otherwise. A missing field value never matches, except under
``!=``, which it always satisfies.
"""

import re
from dataclasses import dataclass, field as dataclass_field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = (">", "<", ">=", "<=", "==", "!=")
RULE_TYPES = ("reject", "approve")

_TEXT = re.compile(r"^\s*(?P<field>.+?)\s*(?P<op>>=|<=|==|!=|>|<)\s*(?P<value>.+?)\s*$")


@dataclass(frozen=True)
class Rule:
    field: str
    op: str
    val: Any


@dataclass
class Strategy:
    id: int
    name: str
    rules: list = dataclass_field(default_factory=list)
    combine_logic: str = "and"
    rule_type: str = "reject"
    priority: int = 0
    status: str = "active"

    def __post_init__(self):
        if self.rule_type not in RULE_TYPES:
            raise ValueError(f"rule_type must be one of {RULE_TYPES}, not {self.rule_type!r}")
        self.rules = [as_rule(r) for r in self.rules]


def as_rule(rule) -> Rule:
    if isinstance(rule, Rule):
        return rule
    if isinstance(rule, str):
        parsed = parse_rules(rule)
        if len(parsed) != 1:
            raise ValueError(f"one condition expected: {rule!r}")
        return parsed[0]
    return Rule(rule["field"], str(rule["op"]).strip(), rule.get("val"))


def parse_rules(text, score_field=None):
    """Rules of a conjunction such as ``a > 1.5 and b <= 3``.

    ``score_field`` replaces the alias ``score`` (any letter case) by a scored column.
    """
    rules = []
    for part in re.split(r"\s+and\s+", text.strip()):
        found = _TEXT.match(part)
        if not found:
            raise ValueError(f"not a rule: {part!r}")
        value = found["value"]
        name = found["field"]
        if score_field and name.lower() == "score":
            name = score_field
        number = as_number(value)
        rules.append(Rule(name, found["op"], value if number is None else number))
    return rules


def as_number(value):
    if isinstance(value, bool):
        return float(value)
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def text_columns_with_numbers(df: DataFrame, rules):
    """Text columns used with a numeric value that hold at least one number: one fused pass."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = sorted({
        r.field for r in map(as_rule, rules)
        if r.op != "in" and as_number(r.val) is not None and isinstance(kinds.get(r.field), T.StringType)
    })
    if not names:
        return set()
    found = df.agg(*[F.max(F.col(f"`{n}`").try_cast("double").isNotNull()).alias(n) for n in names]).first()
    return {n for n in names if found[n]}


def compile_rule(rule, kinds, numeric_text, missing="skip"):
    """Boolean Column that is never null, or None when the rule is to be ignored.

    missing: ``skip`` ignores rules with an unknown field or operator, ``false`` makes them never
    match (and knows ``in``).
    """
    rule = as_rule(rule)
    allowed = OPERATORS + (("in",) if missing == "false" else ())
    if rule.field not in kinds or rule.op not in allowed:
        return None if missing == "skip" else F.lit(False)
    c = F.col(f"`{rule.field}`")
    if rule.op == "in":
        values = rule.val.split(",") if isinstance(rule.val, str) else rule.val
        if not isinstance(values, (list, tuple, set)):
            values = [values]
        return F.coalesce(c.cast("string").isin([str(v).strip() for v in values]), F.lit(False))
    number = as_number(rule.val)
    is_number = isinstance(kinds[rule.field], (T.NumericType, T.BooleanType))
    if number is not None and (is_number or rule.field in numeric_text):
        left, right = (c.cast("double") if is_number else c.try_cast("double")), F.lit(number)
    else:
        left, right = c.cast("string"), F.lit(str(rule.val))
    compared = {
        ">": lambda: left > right,
        "<": lambda: left < right,
        ">=": lambda: left >= right,
        "<=": lambda: left <= right,
        "==": lambda: left == right,
        "!=": lambda: left != right,
    }[rule.op]()
    return F.coalesce(compared, F.lit(rule.op == "!="))


def compile_rules(df: DataFrame, rules, combine_logic="and", missing="skip", numeric_text=None):
    """The rules joined by ``and`` or ``or``; None when no rule is valid."""
    rules = [as_rule(r) for r in rules]
    if numeric_text is None:
        numeric_text = text_columns_with_numbers(df, rules)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    conditions = [compile_rule(r, kinds, numeric_text, missing) for r in rules]
    conditions = [c for c in conditions if c is not None]
    if not conditions:
        return None
    if combine_logic == "and":
        return reduce(Column.__and__, conditions)
    return reduce(Column.__or__, conditions)
