"""Lookups and knowledge-graph facts joined to a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from columnwright.operators.joins import lookup_join
from columnwright.operators.ordering import require_unique_keys
from columnwright.storage import store


def map_values(
    df: DataFrame, on: Sequence[str], lookup: DataFrame, output: str, value: str = "value"
) -> DataFrame:
    """Add ``output`` = the lookup's value for the row's key columns; a miss gives NULL.

    The lookup has one column per key part, named as in the table, and a value column.
    """
    require_unique_keys(lookup, list(on))
    return lookup_join(df, lookup.select(*on, F.col(value).alias(output)), on)


def mapping_frame(df: DataFrame, on: Sequence[str], mapping: Mapping[tuple, object]) -> DataFrame:
    """A lookup table from a dict keyed by tuples of key values."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in on)
    value = {bool: "boolean", int: "bigint", float: "double"}.get(
        type(next(iter(mapping.values()))), "string"
    )
    rows = [(*(k if isinstance(k, tuple) else (k,)), v) for k, v in mapping.items()]
    return df.sparkSession.createDataFrame(rows, f"{kinds}, value {value}")


def enrich(
    df: DataFrame,
    column: str,
    facts: DataFrame,
    relations: Sequence[str],
    prefix: str = "",
) -> DataFrame:
    """Add one column per relation with the fact about the row's value.

    ``facts`` has subject, relation and object. A subject with several objects for one
    relation gets the least; ``<relation>_count`` tells how many there are. Facts are
    combined before the join, so a subject with very many facts is one row.
    """
    wanted = facts.where(F.col("relation").isin(list(relations)))
    per_subject = wanted.groupBy(F.col("subject").alias(column)).agg(
        *[
            agg
            for r in relations
            for agg in (
                F.min(F.when(F.col("relation") == r, F.col("object"))).alias(f"{prefix}{r}"),
                F.count_if(F.col("relation") == r).alias(f"{prefix}{r}_count"),
            )
        ]
    )
    return lookup_join(df, store(per_subject, "facts").df, [column])


def query_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-missing values to ask the knowledge graph about."""
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def novel_requests(candidates: DataFrame, asked: DataFrame) -> DataFrame:
    """Requests whose (column, relation) was not asked before."""
    return lookup_join(
        candidates, asked.select("column", "relation"), ["column", "relation"], "left_anti"
    )
