"""Mixing sources to target weights by temperature.

A source with token share ``p`` gets the weight ``p^a / sum p^a``. The exponent ``a`` in [0, 1]
is found by bisection: the smallest one that keeps the repetitions of every source within a
limit, or the one whose weights have a wanted entropy. The weights are realised as a budget of
tokens per source, spent on seeded permutations of the source's blocks: whole passes first, and
of the last pass as many blocks, in its order, as the budget covers; the block at the border is
split between documents.

Defined results: a null source is a source of its own; empty and null texts have no tokens and
go with their block; a source without tokens is taken once; equal rows of one id share their
place in every permutation; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from columnwright.storage import store

MAX_REPEATS = 2.0
BLOCK_TOKENS = 200_000
SEED = 7
# Halvings of the exponent's range that one pass over the sources answers.
LEVELS, PASSES = 5, 8
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mixture:
    """The exponent, the sum of powered shares, the greatest token count and the budget."""

    exponent: float
    norm: float
    tokens: int
    budget: float


def tokens(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _name(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def _bisect(test: Callable[[list[float]], list[bool]]) -> float:
    """The smallest exponent in [0, 1] that passes a monotone test (1 passes always).

    All midpoints that the next halvings could ask for are tested in one pass.
    """
    low, high = 0.0, 1.0
    if test([0.0])[0]:
        return 0.0
    for _ in range(PASSES):
        n = 1 << LEVELS
        points = [low + (high - low) * i / n for i in range(1, n)]
        passed = dict(zip(points, test(points)))
        for _ in range(LEVELS):
            middle = min(points, key=lambda x: abs(x - (low + high) / 2))
            if passed[middle]:
                high = middle
            else:
                low = middle
            points = [x for x in points if low < x < high] or [middle]
    return high


def temperature(totals: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy_share: float | None = None,
                budget: float | None = None) -> Mixture:
    """Bisect the exponent over (source, tokens) rows; the driver sees sums only.

    The budget is by default the least that takes every source whole at least once, so the
    limit bounds how often the smallest source repeats. ``entropy_share`` asks instead for
    weights with that share of the greatest entropy.
    """
    live = totals.where("tokens > 0")
    row = live.agg(F.sum("tokens"), F.max("tokens"), F.min("tokens"), F.count(F.lit(1))).first()
    total, greatest, least, n = row
    if not n:
        return Mixture(1.0, 1.0, 1, 0.0)
    p = F.col("tokens") / F.lit(float(total))
    if entropy_share is not None:
        wanted = entropy_share * math.log(n)

        def test(points: list[float]) -> list[bool]:
            sums = live.agg(*[
                F.struct(F.sum(F.pow(p, F.lit(a))).alias("z"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias("l"))
                for a in points
            ]).first()
            # Entropy falls as the exponent rises.
            return [math.log(s["z"]) - a * s["l"] / s["z"] <= wanted + 1e-12 for a, s in zip(points, sums)]

        exponent = _bisect(test) if test([1.0])[0] else 1.0
    elif max_repeats is not None:
        def test(points: list[float]) -> list[bool]:
            most = live.agg(*[F.max(F.pow(F.col("tokens") / F.lit(float(greatest)), F.lit(a - 1.0))) for a in points])
            return [x <= max_repeats + 1e-12 for x in most.first()]

        exponent = _bisect(test)
    else:
        exponent = 1.0
    norm = live.agg(F.sum(F.pow(p, F.lit(exponent)))).first()[0]
    if budget is None:
        budget = greatest / ((greatest / total) ** exponent / norm)
    return Mixture(exponent, norm, total, float(budget))


def _block(n_tokens: Column, h: Column) -> Column:
    return F.pmod(h, F.greatest(F.lit(1), F.ceil(n_tokens / F.lit(BLOCK_TOKENS))).cast("long"))


def _order(h: Column, epoch: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), epoch, h)


def plan(documents: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy_share: float | None = None,
         budget: float | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(totals, schedule): what every source gets, and which blocks each of its passes takes.

    ``schedule`` has source, block, epoch, rank (the block's place in the pass) and ``upto``:
    null for a whole block, else the greatest document order of the pass that still fits.
    Texts are read once and not shuffled; blocks keep a hot source in many tasks.
    """
    sized = store(
        documents.select(_name(F.col("source")).alias("source"), tokens(F.col("text")).alias("n"),
                         _row(seed).alias("h")), "sized"
    ).df
    totals = store(sized.groupBy("source").agg(F.sum("n").alias("tokens")), "totals").df
    mixture = temperature(totals, max_repeats, entropy_share, budget)
    share = F.pow(F.col("tokens") / F.lit(float(mixture.tokens)), F.lit(mixture.exponent)) / F.lit(mixture.norm)
    given = F.when(F.col("tokens") > 0, share * F.lit(mixture.budget)).otherwise(F.lit(0.0))
    # Rounding may leave a whole pass a hair short.
    passes = F.when(F.col("tokens") > 0, F.floor(given / F.col("tokens") + F.lit(1e-9))).otherwise(F.lit(1))
    totals = totals.select(
        "source", "tokens", F.when(F.col("tokens") > 0, share).otherwise(0.0).alias("weight"),
        passes.cast("int").alias("passes"),
        F.greatest(F.lit(0), F.floor(given - passes * F.col("tokens") + F.lit(1e-6))).cast("long").alias("left"),
    )
    marked = sized.join(totals, "source").withColumn("block", _block(F.col("tokens"), F.col("h")))
    blocks = marked.groupBy("source", "block").agg(
        F.sum("n").alias("n"), F.first("passes").alias("passes"), F.first("left").alias("left")
    )
    each = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    # Ranks within a pass: one row per block of the source.
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(seed + 1), "epoch", "block"), "block")
    ranked = each.withColumn("rank", F.row_number().over(order)).withColumn("done", F.sum("n").over(order) - F.col("n"))
    last = F.col("epoch") == F.col("passes")
    chosen = ranked.where(~last | (F.col("done") < F.col("left"))).withColumn(
        "room", F.when(last & (F.col("done") + F.col("n") > F.col("left")), F.col("left") - F.col("done"))
    )
    chosen = store(chosen.select("source", "block", "epoch", "rank", "room"), "blocks").df
    # Documents of border blocks, one block per source, in the order of that pass.
    border = marked.join(chosen.where("room IS NOT NULL"), ["source", "block"]).withColumn(
        "at", _order(F.col("h"), F.col("epoch"), seed)
    )
    upto = Window.partitionBy("source").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fitting = (
        border.withColumn("sum", F.sum("n").over(upto)).where("sum <= room")
        .groupBy("source", "block", "epoch").agg(F.max("at").alias("upto"))
    )
    whole = chosen.where("room IS NULL").select(
        "source", "block", "epoch", "rank", F.lit(None).cast("long").alias("upto")
    )
    split = chosen.where("room IS NOT NULL").join(fitting, ["source", "block", "epoch"]).select(
        "source", "block", "epoch", "rank", "upto"
    )
    return totals, store(whole.unionByName(split), "schedule").df


def _row(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                      F.coalesce(F.col("text"), F.lit("")))


def placed(documents: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy_share: float | None = None,
           budget: float | None = None, seed: int = SEED) -> DataFrame:
    """Every taken document, once per pass that takes it: ``__row`` (all columns), ``weight``
    of its source, ``epoch``, ``block`` (place of its block in the pass) and ``place`` (the
    order inside the block).
    """
    totals, schedule = plan(documents, max_repeats, entropy_share, budget, seed)
    columns = [F.col(f"`{c}`") for c in documents.columns]
    rows = documents.select(F.struct(*columns).alias("__row"), _name(F.col("source")).alias("__source"), _row(seed).alias("__h"))
    info = totals.select(F.col("source").alias("__source"), "tokens", "weight")
    blocked = rows.join(info, "__source").withColumn("__block", _block(F.col("tokens"), F.col("__h")))
    wanted = schedule.toDF("__source", "__block", "epoch", "block", "__upto")
    place = _order(F.col("__h"), F.col("epoch"), seed)
    return (
        blocked.join(wanted, ["__source", "__block"])
        .where(F.col("__upto").isNull() | (place <= F.col("__upto")))
        .select("__row", "weight", "epoch", "block", place.alias("place"))
    )


def mix_documents(documents: DataFrame, max_repeats: float | None = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """The rows of the mixture with the columns of ``documents``, repeated as the budget says."""
    return placed(documents, max_repeats, seed=seed).select("__row.*")
