"""Conditional expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from columnwright.functions.missing import flag


def case_where(condition: Column, yes: Column, no: Column) -> Column:
    """One of two values; an unknown condition counts as false."""
    return F.when(condition, yes).otherwise(no)


def flag_conjunction(conditions: Sequence[Column]) -> Column:
    """1 if every condition holds, else 0."""
    return flag(reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conditions]))


def interaction_threshold(gate: Column, threshold: float, value: Column) -> Column:
    """The value where the gate exceeds its threshold, else 0."""
    return F.when(gate > F.lit(threshold), value).otherwise(F.lit(0))


def case_rules(rules: Sequence[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """Value of the first rule whose condition holds."""
    if not rules:
        raise ValueError("at least one rule is needed")
    chain = F.when(rules[0][0], rules[0][1])
    for condition, value in rules[1:]:
        chain = chain.when(condition, value)
    return chain if otherwise is None else chain.otherwise(otherwise)
