"""Column profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from columnwright.functions.missing import finite
from columnwright.storage import store

CONTINUOUS = "continuous values"
# Bytes that the value lists of one profile may hold; longer lists are left out of it.
LIST_BYTES = 64_000_000


def _clean(field: T.StructField) -> Column:
    column = F.col(field.name)
    return finite(column) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else column


def _number(field: T.StructField) -> Column | None:
    """The column as a double to summarise, or None if it has no numeric reading."""
    if isinstance(field.dataType, T.NumericType):
        return _clean(field).cast("double")
    if isinstance(field.dataType, T.TimestampType):
        return F.unix_micros(F.col(field.name)) / F.lit(1e6)
    return None


def column_stats(df: DataFrame) -> DataFrame:
    """Type, missing values and mean / min / max / sample std of every column, in one pass."""
    aggregates, rows = [], []
    for i, field in enumerate(df.schema.fields):
        number = _number(field)
        means = isinstance(field.dataType, T.NumericType)
        aggregates.append(F.count_if(_clean(field).isNull()).alias(f"miss{i}"))
        if number is not None:
            aggregates += [F.min(number).alias(f"min{i}"), F.max(number).alias(f"max{i}")]
        if means:
            aggregates += [F.avg(number).alias(f"mean{i}"), F.stddev_samp(number).alias(f"std{i}")]
        nothing = F.lit(None).cast("double")
        rows.append(
            F.struct(
                F.lit(field.name).alias("column"),
                F.lit(field.dataType.simpleString()).alias("dtype"),
                F.col(f"miss{i}").alias("missing_values"),
                (F.col(f"mean{i}") if means else nothing).alias("mean"),
                (F.col(f"min{i}") if number is not None else nothing).alias("min"),
                (F.col(f"max{i}") if number is not None else nothing).alias("max"),
                (F.col(f"std{i}") if means else nothing).alias("std"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def distinct_counts(df: DataFrame, exact: bool = True) -> DataFrame:
    """Distinct non-missing values per column.

    Exact counts read one column at a time: each branch scans, combines and shuffles only
    its own column, and a hot value is folded before the shuffle. Estimates take one pass.
    """
    fields = df.schema.fields
    if not exact:
        counted = df.agg(*[F.approx_count_distinct(_clean(f)).alias(f"n{i}") for i, f in enumerate(fields)])
        rows = [F.struct(F.lit(f.name).alias("column"), F.col(f"n{i}").alias("unique_count"))
                for i, f in enumerate(fields)]
        return counted.select(F.inline(F.array(*rows)))
    branches = [
        df.select(_clean(f).alias("v")).where("v IS NOT NULL").distinct()
        .agg(F.count("v").alias("unique_count"))
        .select(F.lit(f.name).alias("column"), "unique_count")
        for f in fields
    ]
    return reduce(DataFrame.unionByName, branches)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every non-missing value of the given columns with its count: (column, value, count)."""
    branches = [
        df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.lit(c).alias("column"), "value", "count")
        for c in columns
    ]
    return reduce(DataFrame.unionByName, branches)


def _values(df: DataFrame, columns: Sequence[str], top: int | None) -> tuple[DataFrame, dict[str, int]]:
    """(column, value) of all values or of the ``top`` most frequent ones, and the bytes of each list."""
    counts = value_counts(df, columns)
    if top is not None:
        by_count = Window.partitionBy("column").orderBy(F.desc("count"), "value")
        counts = counts.withColumn("r", F.row_number().over(by_count)).where(F.col("r") <= top)
    values = store(counts.select("column", "value"), "values").df
    sizes = values.groupBy("column").agg(F.sum(F.octet_length("value") + F.lit(8))).collect()  # a row per column
    return values, {name: size for name, size in sizes}


def _lists(values: DataFrame) -> DataFrame:
    return values.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("unique_values"))


def value_lists(
    df: DataFrame, columns: Sequence[str], top: int | None = None, list_bytes: int = LIST_BYTES
) -> DataFrame:
    """Sorted list of all values of each column, or of the ``top`` most frequent ones if asked.

    A cell cannot hold an unbounded list: more than ``list_bytes`` of values in all raise,
    and ``value_counts`` gives them as rows.
    """
    values, sizes = _values(df, columns, top)
    size = sum(sizes.values())
    if size > list_bytes:
        raise ValueError(f"value lists of {size} bytes, more than {list_bytes}: see value_counts")
    return _lists(values)


def profile_counts(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column: type, distinct and missing values, statistics; no value lists."""
    return column_stats(df).join(F.broadcast(distinct_counts(df, exact)), "column")


def profile(df: DataFrame, top: int | None = None, exact: bool = True, list_bytes: int = LIST_BYTES) -> DataFrame:
    """One row per column: type, distinct and missing values, value list, statistics.

    A list holds all values or is null with ``list_omitted`` true: the shortest lists are given
    as long as they hold ``list_bytes`` together. ``value_counts`` gives the values as rows.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    others = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]
    out, omitted = profile_counts(df, exact), []
    if others:
        values, sizes = _values(df, others, top)
        total = 0
        for name in sorted(sizes, key=lambda c: (sizes[c], c)):
            total += sizes[name]
            if total > list_bytes:
                omitted.append(name)
        lists = _lists(values.where(~F.col("column").isin(omitted)))
        out = out.join(F.broadcast(lists), "column", "left")  # measured
    else:
        out = out.withColumn("unique_values", F.lit(None).cast("array<string>"))
    return out.select(
        "column", "dtype", "unique_count", "missing_values",
        F.when(F.col("column").isin(numeric), F.array(F.lit(CONTINUOUS)))
        .when(~F.col("column").isin(omitted), F.coalesce("unique_values", F.array().cast("array<string>")))
        .alias("unique_values"),
        "mean", "min", "max", "std", F.col("column").isin(omitted).alias("list_omitted"),
    )


def profile_json(profiled: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The profile as one JSON list of records, ordered by its first column.

    Missing values are written as JSON null. There is one record per table column.
    """
    records = F.sort_array(F.collect_list(F.struct(*columns)))
    return profiled.agg(F.to_json(records, {"ignoreNullFields": "false"}).alias("profile"))
