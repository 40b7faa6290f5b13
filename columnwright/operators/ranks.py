"""Ranks, category codes and group statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from columnwright.functions.missing import finite, float_columns
from columnwright.operators.joins import lookup_join
from columnwright.operators.ordering import SMALL_ROWS, running_totals
from columnwright.storage import scratch, store


def pct_rank(df: DataFrame, column: str, name: str, small_rows: int = SMALL_ROWS) -> DataFrame:
    """Percentile rank with ties averaged; missing values have none.

    Ranks are worked out on distinct values with their counts and joined back.
    """
    clean = finite(F.col(column)) if column in float_columns(df) else F.col(column)
    counts = (
        df.select(clean.alias(column)).where(F.col(column).isNotNull())
        .groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    )
    counts = store(counts, "counts").df
    ranked = running_totals(counts, column, "__n", "__upto", small_rows)
    total = counts.agg(F.sum("__n").alias("t")).first()["t"]
    ranks = ranked.select(
        column,
        ((F.col("__upto") - (F.col("__n") - 1) / F.lit(2.0)) / F.lit(float(total or 1))).alias(name),
    )
    return lookup_join(df, ranks, [column])


def category_vocabulary(df: DataFrame, column: str, small_rows: int = SMALL_ROWS) -> DataFrame:
    """Distinct non-missing values with dense codes in sorted order: (column, code)."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    values = store(values.withColumn("__one", F.lit(1)), "values").df
    ranked = running_totals(values, column, "__one", "__upto", small_rows)
    return ranked.select(column, (F.col("__upto") - 1).cast("int").alias("code"))


def category_codes(
    df: DataFrame, column: str, name: str, vocabulary: DataFrame | None = None,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Code of the value in sorted order; -1 for missing and for values not in the vocabulary."""
    words = category_vocabulary(df, column, small_rows) if vocabulary is None else vocabulary
    coded = lookup_join(df, words.withColumnRenamed("code", name), [column])
    return coded.withColumn(name, F.coalesce(F.col(name), F.lit(-1)))


def fold_vocabulary(df: DataFrame, column: str, fold: str = "fold") -> DataFrame:
    """(value, fold) pairs that occur, with ``known``: does the value occur outside that fold?

    One count per (value, fold) serves all folds: a value is known to the model of a fold
    if its total exceeds its count inside the fold.
    """
    inside = (
        df.where(F.col(column).isNotNull()).groupBy(column, fold)
        .agg(F.count(F.lit(1)).alias("inside"))
    )
    # At most one row per fold and value is left to sum.
    total = F.sum("inside").over(Window.partitionBy(column))
    return inside.select(column, fold, (total > F.col("inside")).alias("known"))


def category_codes_per_fold(df: DataFrame, column: str, name: str, fold: str = "fold") -> DataFrame:
    """Category code as the model of the row's own fold sees it: -1 for a value that the
    other folds do not hold."""
    coded = category_codes(df, column, name)
    known = store(fold_vocabulary(df, column, fold), "vocabulary").df
    out = lookup_join(coded, known, [column, fold])
    return out.withColumn(
        name, F.when(F.coalesce("known", F.lit(False)), F.col(name)).otherwise(F.lit(-1))
    ).drop("known")


def group_transform(
    df: DataFrame, keys: Sequence[str], value: Column, name: str
) -> DataFrame:
    """An aggregate of the row's group as a column; rows with a missing key get none.

    The aggregate is combined before its shuffle and joined back, so that no task has to
    hold a whole group.
    """
    present = None
    for k in keys:
        present = F.col(k).isNotNull() if present is None else present & F.col(k).isNotNull()
    stats = df.where(present).groupBy(*keys).agg(value.alias(name))
    return lookup_join(df, store(stats, "groups").df, keys)


# Distinct values of one group that a task may rank.
LEAF_VALUES = 10_000
SLICES = 256


def group_quantiles(
    df: DataFrame, keys: Sequence[str], column: str, p: float, leaf_values: int = LEAF_VALUES
) -> DataFrame:
    """``keys`` and ``quantile``: the exact quantile of each group, with linear interpolation.

    Missing values (NaN and infinities too) do not count; a group without values has no row, and
    neither have rows with a missing key. All groups are narrowed down at once: the value range of
    a group is cut into ``SLICES`` equal parts, the parts are counted, and the part that holds the
    wanted rank is the group's next range, until it has at most ``leaf_values`` distinct values.
    Only counts per (group, part) and, at the end, the values of the last ranges meet in a task, so a group
    may hold any share of the rows. A hot value is one value with a count.
    """
    if not 0 <= p <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    keys = list(keys)
    present = None
    for k in keys:
        present = F.col(k).isNotNull() if present is None else present & F.col(k).isNotNull()
    # Minus zero equals zero, but would not group with it in every engine.
    value = finite(F.col(column).cast("double")) + F.lit(0.0)
    rows = df.where(F.lit(True) if present is None else present).select(*keys, value.alias("__v")).where("__v IS NOT NULL")
    with scratch():
        values = store(rows.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n")), "group-values").df
        at = F.lit(p) * (F.sum("__n") - 1)
        # ``__at`` is the rank below the quantile inside the range, ``__share`` how far it is to the next
        # value, ``__next`` the least value beyond the range.
        state = store(values.groupBy(*keys).agg(
            F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.count(F.lit(1)).alias("__m"),
            F.floor(at).cast("long").alias("__at"), (at - F.floor(at)).alias("__share"),
            F.lit(None).cast("double").alias("__next"),
        ), "group-ranges").df
        while state.where(F.col("__m") > leaf_values).limit(1).count():
            state = store(_narrower(values, state, keys, leaf_values), "group-ranges").df
        inside = lookup_join(values, state, keys, "inner").where("__v BETWEEN __low AND __high")
        along = Window.partitionBy(*keys).orderBy("__v")
        ranked = inside.withColumn("__upto", F.sum("__n").over(along)).withColumn(
            "__after", F.coalesce(F.lead("__v").over(along), "__next")
        )
        hit = ranked.where((F.col("__upto") > F.col("__at")) & (F.col("__upto") - F.col("__n") <= F.col("__at")))
        above = F.when(F.col("__upto") > F.col("__at") + 1, F.col("__v")).otherwise(F.coalesce("__after", "__v"))
        found = hit.select(*keys, F.when(F.col("__share") == 0, F.col("__v")).otherwise(
            F.col("__v") + (above - F.col("__v")) * F.col("__share")
        ).alias("quantile"))
        return store(found, "group-quantiles", lasting=True).df


def _narrower(values: DataFrame, state: DataFrame, keys: list[str], leaf_values: int) -> DataFrame:
    """The ranges with the crowded ones cut to the part that holds their rank."""
    crowded = state.where(F.col("__m") > leaf_values)
    inside = lookup_join(values, crowded.select(*keys, "__low", "__high"), keys, "inner").where("__v BETWEEN __low AND __high")
    # Halves first, so that the width of a range cannot overflow.
    width = F.col("__high") / 2 - F.col("__low") / 2
    part = F.least(F.floor((F.col("__v") / 2 - F.col("__low") / 2) / width * F.lit(float(SLICES))), F.lit(SLICES - 1))
    counted = inside.groupBy(*keys, part.alias("__part")).agg(
        F.sum("__n").alias("__n"), F.count(F.lit(1)).alias("__m"), F.min("__v").alias("__low"), F.max("__v").alias("__high")
    )
    along = Window.partitionBy(*keys).orderBy("__part")
    before = counted.withColumn("__upto", F.sum("__n").over(along)).withColumn("__beyond", F.lead("__low").over(along))
    joined = lookup_join(before, crowded.select(*keys, "__at", "__share", "__next"), keys, "inner")
    local = F.col("__at") - (F.col("__upto") - F.col("__n"))
    cut = joined.where((local >= 0) & (local < F.col("__n"))).select(
        *keys, "__low", "__high", "__m", local.alias("__at"), "__share", F.coalesce("__beyond", "__next").alias("__next")
    )
    return state.where(F.col("__m") <= leaf_values).unionByName(cut)


def group_quantile(
    df: DataFrame, keys: Sequence[str], column: str, p: float, name: str, leaf_values: int = LEAF_VALUES
) -> DataFrame:
    """The exact quantile of the row's group as a column; rows with a missing key, or of a group
    without values, get none."""
    found = group_quantiles(df, keys, column, p, leaf_values)
    return lookup_join(df, found.withColumnRenamed("quantile", name), list(keys))
