"""Consecutive ranges of ``doc_id``, so that work in ascending order needs no global sort."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

# Ranges at most; beyond it they grow instead, and tasks spill.
MAX_RANGES = 20_000


@dataclass(frozen=True)
class Ranges:
    """Bounds of consecutive ranges: a row's range follows from its id alone."""

    bounds: list[float]

    @property
    def count(self) -> int:
        return len(self.bounds) + 1

    def mark(self, df: DataFrame, name: str) -> DataFrame:
        """Add the number of the range (int, ascending with the id); null ids are in range 0."""
        if not self.bounds:
            return df.withColumn(name, F.lit(0))
        splits = [float("-inf"), *self.bounds, float("inf")]
        marked = df.withColumn("__id", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
        found = Bucketizer(splits=splits, inputCol="__id", outputCol=name).transform(marked)
        return found.withColumn(name, F.col(name).cast("int")).drop("__id")


def id_ranges(documents: DataFrame, weight: Column, range_weight: float) -> Ranges:
    """Ranges of ids with about ``range_weight`` of the weight each, from a quantile sketch.

    The sketch only chooses the bounds; every row falls into exactly one range whatever they are.
    """
    total = documents.agg(F.sum(weight)).first()[0] or 0
    wanted = int(min(total // range_weight, MAX_RANGES))
    if wanted < 2:
        return Ranges([])
    marks = [i / wanted for i in range(1, wanted)]
    found = documents.where("doc_id IS NOT NULL").agg(
        F.percentile_approx(F.col("doc_id").cast("double"), marks, max(10_000, 10 * wanted))
    ).first()[0]
    return Ranges(sorted(set(found or [])))
