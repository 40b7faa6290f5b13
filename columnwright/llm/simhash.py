"""SimHash near-duplicates by tiled exact comparison.

A text is lower-cased (A-Z), its shingles of four words are hashed with XXH64, and a bit of
the fingerprint is set if more than half of the hashes set it. Fingerprints that differ in at
most ``radius`` bits are linked; components of links are groups of near copies.

Equal fingerprints fall together first. The distinct ones are cut into tiles by population
count and by a hash within one count, so that no tile exceeds ``tile_rows``. Two tiles meet
only if their population counts differ by at most the radius: the counts of two values never
differ by more than the values do. Inside a meeting the same bound is applied to the counts
of the four 16-bit parts, and the rest is exclusive-or and bit count. A meeting returns a
spanning forest of the links it finds, never the pairs themselves, so a group of copies of
any size costs as many rows as it has members.

Defined results: a text without words (empty, null) has fingerprint zero and is linked like
any other; a row with a null ``doc_id`` gets its group's least id (null if no row of the
group has one); repeated rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from columnwright.llm.components import components
from columnwright.llm.words import text_column
from columnwright.storage import store

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE_ROWS = 65_536
# Exclusive-or results that are held at once.
BLOCK = 1 << 19

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """64-bit SimHash of the shingles of ``width`` words, repeats included."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    hashes = np.fromiter(
        [digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())],
        np.uint64, n,
    )
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.bitwise_or.reduce(np.where(2 * ones > n, np.uint64(1) << _BITS, np.uint64(0))))


def fingerprints(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and ``fp`` (the fingerprint as a signed long) of every row; ``carry`` names longs that go along."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch.column(1)).cast(pa.binary())
            values = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *carry]
            )

    schema = ", ".join([f"doc_id {kind}, fp long", *[f"{c} long" for c in carry]])
    return documents.select("doc_id", "text", *carry).mapInArrow(run, schema)


def _parts(values: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit parts, as one row of four per value."""
    return np.bitwise_count(values.view(np.uint16).reshape(-1, 4)).astype(np.int16)


class _Forest:
    """Union-find over positions, with whole blocks of links at a time."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        while True:
            a, b = self.label[left], self.label[right]
            open_ = a != b
            if not open_.any():
                return
            left, right, a, b = left[open_], right[open_], a[open_], b[open_]
            low, high = np.minimum(a, b), np.maximum(a, b)
            # One link for each higher label; the others are looked at again.
            _, pick = np.unique(high, return_index=True)
            self.links += zip(left[pick].tolist(), right[pick].tolist())
            to = np.arange(len(self.label))
            to[high[pick]] = low[pick]
            while True:
                further = to[to]
                if (further == to).all():
                    break
                to = further
            self.label = to[self.label]


def compare_tiles(first: np.ndarray, second: np.ndarray | None, radius: int = RADIUS) -> np.ndarray:
    """Spanning forest (pairs of values) of the links between two tiles, or inside one."""
    same = second is None
    values = first if same else np.concatenate([first, second])
    n = len(first)
    left, right = np.arange(n), np.arange(n) if same else np.arange(n, len(values))
    parts = _parts(np.ascontiguousarray(values))
    code = parts.astype(np.int64) @ np.array([17**3, 17**2, 17, 1])
    left = left[np.argsort(code[left], kind="stable")]
    right = right[np.argsort(code[right], kind="stable")]
    kinds, starts = np.unique(code[left], return_index=True)
    starts = np.append(starts, len(left))
    other, other_starts = np.unique(code[right], return_index=True)
    other_counts = np.diff(np.append(other_starts, len(right)))
    kind_parts, other_parts = parts[left[starts[:-1]]], parts[right[other_starts]]
    forest = _Forest(len(values))
    for i in range(len(kinds)):
        near = np.abs(other_parts - kind_parts[i]).sum(1) <= radius
        if same:
            near &= other >= kinds[i]
        cols = right[np.repeat(near, other_counts)]
        if not len(cols):
            continue
        run = left[starts[i] : starts[i + 1]]
        step = max(1, BLOCK // len(cols))
        for at in range(0, len(run), step):
            rows = run[at : at + step]
            hit = np.bitwise_count(values[rows][:, None] ^ values[cols][None, :]) <= radius
            r, c = np.nonzero(hit)
            forest.add(rows[r], cols[c])
    if not forest.links:
        return np.zeros((0, 2), np.uint64)
    return values[np.array(forest.links)]


def near_links(values: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): links that connect every group of ``fp`` values within ``radius`` of each other.

    ``values`` holds distinct values and should be stored. Shuffled per value: one row per
    tile its own tile meets, as packed arrays. There is no cap: a population count with more
    values than ``tile_rows`` has more tiles.
    """
    count = F.bit_count("fp")
    sizes = dict(values.groupBy(count.alias("__count")).count().collect())  # 65 rows at most
    tiles = {c: -(-n // tile_rows) for c, n in sizes.items()}
    if not tiles:
        return values.sparkSession.createDataFrame([], "a long, b long")
    per_count = F.element_at(
        F.create_map(*[F.lit(x) for item in sorted(tiles.items()) for x in item]), F.col("__count")
    )
    ids = {}
    for c in sorted(tiles):
        for s in range(tiles[c]):
            ids[c, s] = len(ids)
    first_id = F.create_map(*[F.lit(x) for c in sorted(tiles) for x in (c, ids[c, 0])])
    tiled = values.select("fp", count.alias("__count")).select(
        "fp", "__count",
        (F.element_at(first_id, F.col("__count")) + F.pmod(F.xxhash64("fp"), per_count).cast("int")).alias("tile"),
    )
    packed = (
        tiled.groupBy("tile").agg(F.first("__count").alias("__count"), F.sort_array(F.collect_list("fp")).alias("fps"))
    )
    # Tiles that a tile meets: those of counts up to the radius away, as ranges of ids.
    last = {c: ids[c, tiles[c] - 1] for c in tiles}
    upto = F.create_map(*[
        F.lit(x) for c in sorted(tiles) for x in (c, max(last[d] for d in tiles if c <= d <= c + radius))
    ])
    down = F.create_map(*[
        F.lit(x) for c in sorted(tiles) for x in (c, min(ids[d, 0] for d in tiles if c - radius <= d <= c))
    ])
    meetings = packed.select(
        "tile", "fps",
        F.explode(F.sequence(F.element_at(down, F.col("__count")), F.element_at(upto, F.col("__count")))).alias("other"),
    ).select(
        F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "fps"
    )

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("tile")
        sides = [np.asarray(x, np.int64).view(np.uint64) for x in group["fps"]]
        found = compare_tiles(sides[0], sides[1] if len(sides) > 1 else None, radius).view(np.int64)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return meetings.groupBy("low", "high").applyInPandas(meet, "a long, b long")


def _roots(values: DataFrame, radius: int, tile_rows: int) -> DataFrame:
    """``values`` (distinct ``fp``) with ``root``, the least fingerprint of its component."""
    groups = components(near_links(values, radius, tile_rows)).df.toDF("fp", "root")
    return values.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(documents: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    rows = store(fingerprints(documents), "fingerprints").df
    values = store(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "values").df
    rooted = _roots(values, radius, tile_rows)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_value = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(by_value, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(documents: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row of each group, with all columns.

    It is the row with the least ``doc_id``; rows without one come last, and rows with equal
    ids, or none, go by a hash of id and text. So every group keeps exactly one row, also if
    an id repeats with other texts or is missing. Of rows that are equal in both, the one with
    the least hash of all columns stays. Texts are shuffled once.
    """
    columns = [F.col(f"`{c}`") for c in documents.columns]
    # Two 64-bit hashes stand for (id, text).
    named = lambda seed: F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), F.col("doc_id"), F.coalesce("text", F.lit("")))
    found = fingerprints(documents.select("doc_id", "text", named(1).alias("k1"), named(2).alias("k2")), ("k1", "k2"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    values = store(found.groupBy("fp").agg(F.min(rank).alias("least")), "values").df
    first = _roots(values, radius, tile_rows).groupBy("root").agg(F.min("least").alias("least"))
    keys = first.select(F.col("least.k1").alias("__k1"), F.col("least.k2").alias("__k2"))
    rows = documents.select(F.struct(*columns).alias("__row"), named(1).alias("__k1"), named(2).alias("__k2"), F.xxhash64(*columns).alias("__all"))
    kept = rows.join(keys, ["__k1", "__k2"], "left_semi").groupBy("__k1", "__k2").agg(F.min_by("__row", "__all").alias("__row"))
    return kept.select("__row.*")
