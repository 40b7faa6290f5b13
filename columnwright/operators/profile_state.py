"""Profiles that can be added to: new files update a profile without a scan of the old ones.

A state holds what parts of a table say about its columns. States of disjoint parts combine in
any order and grouping to that of the whole: counts, extremes and distinct values exactly, means
and deviations up to rounding.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from columnwright.operators.profile import _clean, _number
from columnwright.storage import delete

MOMENTS = (
    "column string, dtype string, rows long, missing_values long, n long, mean double, "
    "m2 double, min double, max double, sketch binary"
)
VALUES = "column string, value string, count long"
# 2^12 registers: an estimate is off by 1.6 % (one standard error).
SKETCH_BITS = 12


@dataclass(frozen=True)
class ProfileState:
    """``moments`` has a row per column; ``values`` every value with its count, or is None if
    distinct values are only estimated from sketches."""

    moments: DataFrame
    values: DataFrame | None


def _text(field: T.StructField):
    """A text per value: equal values have one, 0.0 and -0.0 too."""
    clean = _clean(field)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        clean = clean + F.lit(0.0).cast(field.dataType)
    return clean.cast("string")


def measure(df: DataFrame, exact: bool = True) -> ProfileState:
    """State of one part. All moments and sketches take one pass; exact values read one column
    at a time and are combined before their shuffle. A part without rows, or a column without
    values, has zero counts and no mean.
    """
    aggregates, rows = [F.count(F.lit(1)).alias("rows")], []
    nothing = F.lit(None).cast("double")
    for i, field in enumerate(df.schema.fields):
        number = _number(field)
        means = isinstance(field.dataType, T.NumericType)
        aggregates.append(F.count_if(_clean(field).isNull()).alias(f"miss{i}"))
        if number is not None:
            aggregates += [F.min(number).alias(f"min{i}"), F.max(number).alias(f"max{i}")]
        if means:
            aggregates += [
                F.count(number).alias(f"n{i}"), F.avg(number).alias(f"mean{i}"),
                (F.var_pop(number) * F.count(number)).alias(f"m2{i}"),
            ]
        if not exact:
            aggregates.append(F.hll_sketch_agg(_text(field), SKETCH_BITS).alias(f"sketch{i}"))
        rows.append(F.struct(
            F.lit(field.name).alias("column"),
            F.lit(field.dataType.simpleString()).alias("dtype"),
            F.col("rows"),
            F.col(f"miss{i}").alias("missing_values"),
            (F.col(f"n{i}") if means else F.lit(None).cast("long")).alias("n"),
            (F.col(f"mean{i}") if means else nothing).alias("mean"),
            (F.col(f"m2{i}") if means else nothing).alias("m2"),
            (F.col(f"min{i}") if number is not None else nothing).alias("min"),
            (F.col(f"max{i}") if number is not None else nothing).alias("max"),
            (F.lit(None).cast("binary") if exact else F.col(f"sketch{i}")).alias("sketch"),
        ))
    moments = df.agg(*aggregates).select(F.inline(F.array(*rows)))
    if not exact:
        return ProfileState(moments, None)
    branches = [
        df.select(_text(f).alias("value")).where("value IS NOT NULL").groupBy("value")
        .agg(F.count(F.lit(1)).alias("count")).select(F.lit(f.name).alias("column"), "value", "count")
        for f in df.schema.fields
    ]
    return ProfileState(moments, reduce(DataFrame.unionByName, branches))


def combine(states: Sequence[ProfileState]) -> ProfileState:
    """State of all parts together; the parts must be disjoint.

    A column that some parts lack is described by the parts that have it; one whose type
    differs between parts raises. Exact and estimated states do not mix.
    """
    exact = {s.values is not None for s in states}
    if len(exact) != 1:
        raise ValueError("states to combine are all exact or all estimated, and at least one")
    parts = reduce(DataFrame.unionByName, [s.moments for s in states])
    values = None
    if exact.pop():
        values = reduce(DataFrame.unionByName, [s.values for s in states])
    return _fold(parts, values)


def _fold(parts: DataFrame, values: DataFrame | None) -> ProfileState:
    means = parts.groupBy("column").agg((F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))).alias("all"))
    # A row per column of the profiled table. Distances from the common mean do not cancel out,
    # as sums of squares would.
    spread = F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("all"), 2)
    kind = F.when(F.min("dtype") == F.max("dtype"), F.min("dtype")).otherwise(
        F.raise_error(F.concat(F.lit("types differ between parts: "), F.col("column")))
    )
    folded = parts.join(F.broadcast(means), "column").groupBy("column").agg(
        kind.alias("dtype"), F.sum("rows").alias("rows"), F.sum("missing_values").alias("missing_values"),
        F.sum("n").alias("n"), F.first("all").alias("mean"), F.sum(spread).alias("m2"),
        F.min("min").alias("min"), F.max("max").alias("max"),
        (F.lit(None).cast("binary") if values is not None else F.hll_union_agg("sketch")).alias("sketch"),
    )
    if values is not None:
        values = values.groupBy("column", "value").agg(F.sum("count").alias("count"))
    return ProfileState(folded, values)


def finish(state: ProfileState) -> DataFrame:
    """(column, dtype, unique_count, missing_values, mean, min, max, std), as ``profile_counts``."""
    if state.values is None:
        counted = state.moments.withColumn("unique_count", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)))
    else:
        distinct = state.values.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
        # A row per column of the profiled table.
        counted = state.moments.join(F.broadcast(distinct), "column", "left").withColumn(
            "unique_count", F.coalesce("unique_count", F.lit(0))
        )
    spread = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return counted.select(
        "column", "dtype", "unique_count", "missing_values", "mean", "min", "max", spread.alias("std")
    )


def write_part(state: ProfileState, path: str, part: str) -> None:
    """Write the state of one part to a folder of many.

    A part written again takes the place of what it held, so a repeated load counts once. The
    moments go first and come last: readers take only parts that have them.
    """
    root = path.rstrip("/")
    delete(state.moments.sparkSession, f"{root}/moments/part={part}")
    if state.values is not None:
        state.values.write.mode("overwrite").parquet(f"{root}/values/part={part}")
    state.moments.write.mode("overwrite").parquet(f"{root}/moments/part={part}")


def read_parts(spark: SparkSession, path: str, exact: bool = True) -> ProfileState:
    """Combined state of all parts below ``path``."""
    root = path.rstrip("/")
    # Names of parts stay texts, whatever they look like.
    read = lambda schema: spark.read.schema(f"{schema}, part string")
    parts = read(MOMENTS).parquet(f"{root}/moments")
    if not exact:
        return _fold(parts.drop("part"), None)
    done = parts.select("part").distinct()  # a row per part
    values = read(VALUES).parquet(f"{root}/values").join(F.broadcast(done), "part", "left_semi")
    return _fold(parts.drop("part"), values.drop("part"))
