"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from columnwright.storage import Stored, store

MAX_ROUNDS = 60


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One contraction: neighbours of a node are hung below the least node it sees.

    The least neighbour is a grouped minimum, combined before the shuffle, that is joined
    back; no node's neighbours are ever collected.
    """
    a, b = F.col("a"), F.col("b")
    if large:
        sides = links.select("a", "b").union(links.select(b.alias("a"), a.alias("b")))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("__least"))
        return (
            sides.join(least, "a").where("b > a")
            .select(F.col("b").alias("a"), F.col("__least").alias("b"))
            .where("a <> b").distinct()
        )
    # small: a > b in every link
    least = links.groupBy("a").agg(F.min("b").alias("__least"))
    joined = links.join(least, "a")
    return (
        joined.select("b", "__least").union(joined.select("a", "__least")).toDF("a", "b")
        .where("a <> b").distinct()
    )


def _summary(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def components(links: DataFrame) -> Stored:
    """(a, b): every node ``a`` that is not the least of its component, with the least one ``b``.

    ``links`` has two columns of one ordered type; a link of a node to itself or with a null
    is ignored, repeated links count once. Each round is written to the shared folder, so a
    lost executor costs one round at most. Rounds grow with the logarithm of the longest
    chain; the driver sees only a count and a checksum per round.
    """
    a, b = links.columns
    now = store(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(),
        "links",
    )
    seen = _summary(now.df)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            return now
        after = store(_stars(_stars(now.df, large=True), large=False), "links")
        now.drop()
        now, before = after, seen
        seen = _summary(now.df)
        if seen == before:
            return now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
