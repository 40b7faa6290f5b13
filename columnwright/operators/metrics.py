"""Scores of predictions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from columnwright.operators.ordering import running_totals
from columnwright.storage import store

# Bits folded per level. Twenty bits mean that no task ever ranks more than 2**20 entries
# at a time; what is left after the listed levels is folded at once.
WIDE_LEVELS = (20, 20)
NARROW_LEVELS = (20,)


def _binary(label: Column) -> Column:
    """The label as 0.0 / 1.0 / NULL; any other value raises."""
    y = label.cast("double")
    return F.when(y.isNull() | y.isin(0.0, 1.0), y).otherwise(F.raise_error(F.lit("the label must be 0 or 1")))


def auc(
    df: DataFrame,
    label: str,
    score: str | Column,
    by: Sequence[str] = (),
    name: str = "auc",
    levels: Sequence[int] = WIDE_LEVELS,
) -> DataFrame:
    """Exact ROC AUC per group; NULL if a class is missing. ``label`` is 0/1, else it raises.

    Rows without a label or a score (NaN is none) do not count. Rows are first folded to
    counts per distinct score; scores that are not whole numbers are then numbered in their
    order. Neighbouring scores are folded into buckets, and buckets into bigger ones: ``won``
    is the number of (positive, negative) pairs inside that are in the right order, ties
    counting half. Neither a hot score nor a big group reaches one task as rows.
    """
    part = _counts(df, label, score, by)
    part = part.withColumn("__won", F.col("__pos") * F.col("__neg") / 2)
    for bits in levels:
        part = _fold(part.withColumn("__up", F.shiftright("__g", bits)), [*by, "__up"])
        part = part.withColumnRenamed("__up", "__g")
    return _fold(part, list(by)).select(
        *by, F.try_divide(F.col("__won"), F.col("__pos") * F.col("__neg")).alias(name)
    )


def _counts(df: DataFrame, label: str, score: str | Column, by: Sequence[str], numbered: bool = True) -> DataFrame:
    """Rows of both classes per distinct score, which is a whole number afterwards if ``numbered``."""
    column = F.col(score) if isinstance(score, str) else score
    rows = df.select(*by, _binary(F.col(label)).alias("__y"), column.alias("__g"))
    kind = rows.schema["__g"].dataType.simpleString()
    if kind in ("double", "float"):
        rows = rows.withColumn("__g", F.nanvl(F.col("__g"), F.lit(None).cast(kind)))
    part = (
        rows.where("__y IS NOT NULL AND __g IS NOT NULL").groupBy(*by, "__g")
        .agg(F.sum("__y").alias("__pos"), F.sum(1 - F.col("__y")).alias("__neg"))
    )
    if not numbered:
        return part
    if kind in ("int", "bigint"):
        part = part.withColumn("__g", F.col("__g").cast("bigint"))
    else:
        part = _numbered(store(part, "score-counts").df)
    return part


def best_accuracy(
    df: DataFrame,
    label: str,
    score: str | Column,
    by: Sequence[str] = (),
    name: str = "accuracy",
    levels: Sequence[int] = WIDE_LEVELS,
) -> DataFrame:
    """Accuracy per group at the threshold that suits the group's rows best.

    Scores above the threshold count as class 1; it may lie below or above all scores. With
    ``n`` negatives and ``p`` positives up to a score, ``n - p`` more rows are right than if all
    were called positive, so the best threshold is where that running sum is greatest. Sums and
    maxima of neighbouring scores fold into bigger buckets like those of ``auc``. The label is
    0/1, else it raises; rows without a label or a score do not count.
    """
    part = _counts(df, label, score, by).withColumn("__gain", F.greatest(F.lit(0.0), F.col("__neg") - F.col("__pos")))
    for bits in levels:
        part = _fold_gain(part.withColumn("__up", F.shiftright("__g", bits)), [*by, "__up"])
        part = part.withColumnRenamed("__up", "__g")
    return _fold_gain(part, list(by)).select(
        *by, F.try_divide(F.col("__gain") + F.col("__pos"), F.col("__pos") + F.col("__neg")).alias(name)
    )


def _fold_gain(part: DataFrame, into: Sequence[str]) -> DataFrame:
    before = Window.partitionBy(*into).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(F.col("__neg") - F.col("__pos")).over(before), F.lit(0.0))
    return part.withColumn("__gain", F.col("__gain") + ahead).groupBy(*into).agg(
        F.max("__gain").alias("__gain"), F.sum("__pos").alias("__pos"), F.sum("__neg").alias("__neg")
    )


def neg_log_loss(
    df: DataFrame,
    label: str,
    score: str | Column,
    by: Sequence[str] = (),
    name: str = "neg_log_loss",
    levels: Sequence[int] = (),
    unit: float = 1_000.0,
) -> DataFrame:
    """Mean log likelihood of the labels per group (0 is the best), for scores that are log odds
    in parts of ``unit``. Worked out once per distinct score; ``levels`` play no part."""
    part = _counts(df, label, score, by, numbered=False)
    odds = F.col("__g").cast("double") / F.lit(unit)
    loss = lambda z: F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    return part.groupBy(*by).agg(
        F.try_divide(-F.sum(F.col("__pos") * loss(-odds) + F.col("__neg") * loss(odds)), F.sum(F.col("__pos") + F.col("__neg"))).alias(name)
    )


def _numbered(part: DataFrame) -> DataFrame:
    """Counts with each distinct score replaced by its place in the order of all scores."""
    distinct = store(part.select("__g").distinct().withColumn("__one", F.lit(1)), "scores").df
    places = running_totals(distinct, "__g", "__one", "__place").select("__g", "__place")
    return part.join(places, "__g").drop("__g").withColumnRenamed("__place", "__g")


def _fold(part: DataFrame, into: Sequence[str]) -> DataFrame:
    before = Window.partitionBy(*into).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    less = F.coalesce(F.sum("__neg").over(before), F.lit(0.0))
    return part.withColumn("__won", F.col("__won") + F.col("__pos") * less).groupBy(*into).agg(
        F.sum("__won").alias("__won"), F.sum("__pos").alias("__pos"), F.sum("__neg").alias("__neg")
    )


# Scores that selection can go by; more is better.
METRICS = {"auc": auc, "accuracy": best_accuracy, "neg_log_loss": neg_log_loss}
# What a group without a score counts as.
WORST = {"auc": 0.0, "accuracy": 0.0, "neg_log_loss": -1e9}


def metric_named(name: str) -> Callable[..., DataFrame]:
    if name not in METRICS:
        raise ValueError(f"unknown metric: {name!r}")
    return METRICS[name]


def accuracy(truth: Column, prediction: Column) -> Column:
    """Share of equal pairs; a missing prediction is a wrong one."""
    return F.avg(F.coalesce(truth == prediction, F.lit(False)).cast("double"))


def score_by(
    df: DataFrame,
    metric: Callable[[Column, Column], Column],
    truth: str,
    prediction: str,
    by: Sequence[str] = (),
    name: str = "score",
) -> DataFrame:
    """Any aggregate of (truth, prediction) per group; ``metric`` builds the Column."""
    return df.groupBy(*by).agg(metric(F.col(truth), F.col(prediction)).alias(name))


def mean_score(df: DataFrame, score: str, by: Sequence[str] = (), name: str = "score") -> DataFrame:
    """Mean of the scores that are there (missing ones are skipped) per group."""
    return df.groupBy(*by).agg(F.avg(score).alias(name))


def distinct_classes(df: DataFrame, label: str) -> DataFrame:
    """Sorted distinct classes, in lower case."""
    return df.select(F.lower(F.col(label)).alias(label)).distinct().orderBy(label)


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def block_count(df: DataFrame, size: int) -> DataFrame:
    """Number of full blocks of ``size`` rows."""
    return df.agg((F.count(F.lit(1)) / F.lit(size)).cast("bigint").alias("n_blocks"))
