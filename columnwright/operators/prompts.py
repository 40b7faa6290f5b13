"""Scoring text prompts on a labelled text table, with a prediction cache."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from columnwright.functions.hashing import row_hash
from columnwright.operators.joins import lookup_join

PAIR = ["prompt", "x", "y"]


def text_task(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Key columns, ``x`` (text) and ``y`` (label in lower case)."""
    return df.select(*keys, F.col(x).alias("x"), F.lower(F.col(y)).alias("y"))


def pairs_cross(examples: DataFrame, prompts: Sequence[str]) -> DataFrame:
    """Every prompt with every example. The prompts are a given list, so each row is
    repeated where it lies; nothing is joined."""
    given = F.array(*[F.lit(p) for p in prompts]) if prompts else F.array().cast("array<string>")
    return examples.select(F.explode(given).alias("prompt"), "*")


def pairs_to_predict(pairs: DataFrame, cache: DataFrame, strategy: str = "full") -> DataFrame:
    """Pairs that are not in the cache. Strategy ``evaluated`` asks for none."""
    if strategy == "evaluated":
        return pairs.where(F.lit(False))
    return lookup_join(pairs, cache.select(*PAIR), PAIR, "left_anti")


def cache_collect(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """Pairs with their cached score and sequence; NULL for those not in the cache.

    The cache has one row per (prompt, x, y).
    """
    return lookup_join(pairs, cache.select(*PAIR, "score", "sequence"), PAIR)


def score_predictions(predictions: DataFrame, match: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Cache rows from predictions (prompt, x, y, prediction, sequence), one per pair.

    The score of a pair is 1 or 0, or what ``match(y, prediction)`` gives. Repeated pairs
    are combined before they are shuffled.
    """
    if match is None:
        match = lambda y, p: F.coalesce((y == p), F.lit(False)).cast("double")
    scored = predictions.withColumn("score", match(F.col("y"), F.col("prediction")))
    return scored.groupBy(*PAIR).agg(F.min("score").alias("score"), F.min("sequence").alias("sequence"))


def extend_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new rows; a key that is there keeps its first score."""
    return cache.unionByName(lookup_join(new, cache.select(*PAIR), PAIR, "left_anti"))


def prompt_scores(collected: DataFrame) -> DataFrame:
    """Mean score per prompt; pairs without a score are skipped."""
    return collected.groupBy("prompt").agg(F.avg("score").alias("score"))


def prompt_leaderboard(scores: DataFrame) -> DataFrame:
    """Prompts by score, best first."""
    return scores.orderBy(F.desc_nulls_last("score"), "prompt")


def exemplars_random(
    examples: DataFrame, keys: Sequence[str], prompts: Sequence[str], n: int, seeds: Sequence[int] = (42,)
) -> DataFrame:
    """``n`` examples per (prompt, seed), as text put before the prompt.

    Each task keeps its own first ``n`` per (prompt, seed) before the shuffle, so a group
    never gathers more than ``n`` rows per task.
    """
    marks = F.array(*[
        F.struct(F.lit(p).alias("prompt"), F.lit(s).alias("seed")) for p in prompts for s in seeds
    ])
    tagged = examples.select("*", F.inline(marks))
    h = F.md5(F.concat_ws("|", row_hash(keys), "prompt", F.col("seed").cast("string")))
    first = Window.partitionBy("prompt", "seed").orderBy("h", *keys)
    picked = (
        tagged.withColumn("h", h).withColumn("r", F.row_number().over(first)).where(F.col("r") <= n)
    )
    line = F.concat(F.lit("Input: "), F.col("x"), F.lit("\nOutput: "), F.col("y"))
    lines = F.sort_array(F.collect_list(F.struct("r", line.alias("line"))))
    return picked.groupBy("prompt", "seed").agg(
        F.concat(
            F.concat_ws("\n\n", F.transform(lines, lambda e: e["line"])), F.lit("\n\n"), F.col("prompt")
        ).alias("text")
    )


def exemplars_search(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Of each prompt's candidates (prompt, seed, text) the best scored (text, score);
    of equal ones the lowest seed."""
    joined = candidates.join(
        scores.select(F.col("prompt").alias("text"), "score"), "text", "left"
    )
    best = F.max_by(
        F.struct("seed", "text", "score"),
        F.struct(F.coalesce("score", F.lit(-1.0)), -F.col("seed")),
    )
    return joined.groupBy("prompt").agg(best.alias("b")).select("prompt", "b.*")
