"""The run ledger: one row per round; which rounds count, and how they are shown.

A ledger holds at most one row per round of a run. ``by`` names the run columns of a
table with many ledgers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

PERFECT = 0.9999999


def accept_rounds(
    ledger: DataFrame, score: str = "score", by: Sequence[str] = (), status: str | None = None
) -> DataFrame:
    """Add ``accepted``: is the score strictly above every earlier one? Failed rounds
    have none and are never accepted; round 0 is the baseline."""
    earlier = Window.partitionBy(*by).orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    value = F.col(score) if status is None else F.when(F.col(status) != "failed", F.col(score))
    return ledger.withColumn("accepted", F.coalesce(value > F.max(value).over(earlier), F.lit(False)))


def stop_rounds(
    ledger: DataFrame, score: str = "score", by: Sequence[str] = (), perfect: float = PERFECT
) -> DataFrame:
    """Drop the rounds after the first one with a perfect score. Round 0, the baseline,
    stops nothing."""
    hit = F.when((F.col(score) > F.lit(perfect)) & (F.col("round") > 0), F.col("round"))
    first = F.min(hit).over(Window.partitionBy(*by))
    return (
        ledger.withColumn("__stop", first)
        .where(F.col("__stop").isNull() | (F.col("round") <= F.col("__stop")))
        .drop("__stop")
    )


def history_tail(ledger: DataFrame, n: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` rounds of each run."""
    last = Window.partitionBy(*by).orderBy(F.desc("round"))
    return ledger.withColumn("__r", F.row_number().over(last)).where(F.col("__r") <= n).drop("__r")


def history_zip(responses: DataFrame, selected: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Responses paired with the features selected in the same round; the shorter ends it."""
    return responses.join(selected, [*by, "round"], "inner")


def render_history(history: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Text of each run's trials in order (response, selected); ``None`` without any."""
    trials = F.sort_array(F.collect_list(F.struct("round", "response", "selected")))
    lines = F.transform(
        trials,
        lambda t, i: F.concat(
            F.lit("Trial "), (i + 1).cast("string"), F.lit(":\nPrompt: "), t["response"],
            F.lit("\nSelected Features: "), t["selected"], F.lit("\n"),
        ),
    )
    text = F.array_join(lines, "\n")
    return history.groupBy(*by).agg(
        F.when(F.count(F.lit(1)) > 0, text).otherwise(F.lit("None")).alias("history")
    )


def compare_scores(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per run with the mean score of each step: before, added, pruned.

    ``scores`` has (step, score) rows, one per fold.
    """
    steps = ("before", "added", "pruned")
    return scores.groupBy(*by).agg(
        *[F.avg(F.when(F.col("step") == s, F.col("score"))).alias(f"score_{s}") for s in steps]
    )
