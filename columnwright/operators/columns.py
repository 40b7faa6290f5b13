"""Projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from columnwright.functions.missing import non_numeric_columns, numeric_columns


def xy_split(df: DataFrame, keys: Sequence[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Features (without the label) and labels, both with the row keys."""
    return df.drop(label), df.select(*keys, label)


def project_selected(
    df: DataFrame, keys: Sequence[str], selected: Sequence[str], label: str
) -> DataFrame:
    """Row keys, the chosen features and the label."""
    missing = [c for c in selected if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*dict.fromkeys([*keys, *selected, label]))


def select_by_type(df: DataFrame, numeric: bool = True) -> DataFrame:
    """Only the numeric (or only the other) columns."""
    return df.select(*(numeric_columns(df) if numeric else non_numeric_columns(df)))


def feature_columns(df: DataFrame, keys: Sequence[str], label: str, extra: Sequence[str] = ()) -> list[str]:
    skip = {*keys, label, *extra}
    return [c for c in df.columns if c not in skip]


def binary_label(df: DataFrame, label: str, positive: object) -> DataFrame:
    """The label as 1 for the positive value, 0 for any other, NULL for missing."""
    return df.withColumn(label, (F.col(label) == F.lit(positive)).cast("int"))


def prune_accept(before: Sequence[str], selected: Sequence[str]) -> bool:
    """A pruned set counts only if every name exists and it is smaller."""
    return len(selected) < len(before) and set(selected) <= set(before)


def prune_accept_rows(sets: DataFrame, before: str, selected: str) -> DataFrame:
    """The same test on two array columns, as ``accepted``."""
    missing = F.array_except(selected, before)
    smaller = F.size(F.array_distinct(selected)) < F.size(F.array_distinct(before))
    return sets.withColumn("accepted", (F.size(missing) == 0) & smaller)
