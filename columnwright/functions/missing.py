"""Missing values: NaN and infinities count as NULL, flags are never NULL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def non_numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]


def float_columns(df: DataFrame) -> list[str]:
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]


def finite(column: Column) -> Column:
    """NaN, +Inf and -Inf become NULL."""
    bad = F.isnan(column) | (F.abs(column) == F.lit(float("inf")))
    return F.when(~bad, column)


def inf_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Apply :func:`finite` to the given (or all) floating-point columns."""
    names = set(float_columns(df) if columns is None else columns)
    return df.select(*[finite(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


def impute_zero(df: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """Missing values of numeric columns become 0; other columns are left alone."""
    skip = set(exclude)
    names = [c for c in numeric_columns(df) if c not in skip]
    return inf_to_null(df, [c for c in float_columns(df) if c not in skip]).na.fill(0, names)


def to_feature_matrix(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Cast the given columns to double."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or cannot be known."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def negate(condition: Column) -> Column:
    """Negation in which an unknown condition counts as false before it is negated."""
    return ~F.coalesce(condition, F.lit(False))
