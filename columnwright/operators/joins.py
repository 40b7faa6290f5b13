"""Left lookups that stay safe when the lookup is big or a key is hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128 * 1024 * 1024
HOT_ROWS = 1_000_000
HOT_PARTS = 4_000
SALTS = 64


def _holds_map(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString()


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure (not guess) whether a table is small enough to send to every executor."""
    if df.count() > max_rows:
        return False
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))
    return df.agg(size.alias("size")).first()["size"] <= max_bytes


def hot_key_hashes(
    df: DataFrame, key_hash: Column, min_rows: int = HOT_ROWS, parts: int = HOT_PARTS
) -> list[int]:
    """Hashes of the keys that hold more than ``max(min_rows, n / parts)`` rows.

    At most ``parts`` keys can qualify, so the list is bounded whatever the data.
    """
    limit = max(min_rows, df.count() // parts)
    counted = df.groupBy(key_hash.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return [r["h"] for r in counted.where(F.col("n") > limit).select("h").collect()]


def lookup_join(
    df: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    small: bool | None = None,
    min_hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join rows with a lookup on key columns; NULL keys match NULL keys.

    ``how`` is ``left``, ``inner``, ``left_semi`` or ``left_anti``. A lookup of measured
    small size is broadcast. A bigger one is shuffled, and the rows of hot keys are
    spread over ``salts`` partitions against as many copies of their lookup rows. A
    lookup that is costly to work out should be stored before.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    on = list(on)
    names = {c: f"__k_{c}" for c in on}
    right = lookup.withColumnsRenamed(names)
    equal = [F.col(c).eqNullSafe(F.col(names[c])) for c in on]
    if small is None:
        small = fits_broadcast(lookup)
    if small:
        return df.join(F.broadcast(right), equal, how).drop(*names.values())

    key_hash = F.xxhash64(*[F.col(c) for c in on])
    hot = hot_key_hashes(df, key_hash, min_hot_rows)
    if not hot:
        return df.join(right, equal, how).drop(*names.values())
    # The salt is a hash of the whole row (key columns make it spread), so a retried task
    # sends every row where the first attempt did.
    place = F.xxhash64(*[F.col(f.name) for f in df.schema.fields if not _holds_map(f.dataType)])
    left = df.withColumn("__h", key_hash).withColumn(
        "__salt", F.when(F.col("__h").isin(hot), F.pmod(place, F.lit(salts))).otherwise(F.lit(0))
    )
    right = right.withColumn("__rh", F.xxhash64(*[F.col(n) for n in names.values()])).withColumn(
        "__rsalt",
        F.explode(
            F.when(F.col("__rh").isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
                F.array(F.lit(0))
            )
        ),
    )
    equal.append(F.col("__salt") == F.col("__rsalt"))
    extra = ["__h", "__salt", "__rh", "__rsalt", *names.values()]
    return left.join(right, equal, how).drop(*extra)
