"""URL filters: rules for hosts and paths, and a Bloom filter cascade for a list of addresses.

The cascade encodes a list of keys against the complete key universe of the corpus. Level one
is a Bloom filter of the listed keys; level two holds those other keys of the universe that
level one lets through; level three the listed keys that level two catches wrongly; and so on
until a level catches nothing wrong. A key of the universe is listed exactly if the first level
that misses it is an even one (or none misses it and the number of levels is odd).

Defined results: a null address, or one without ``://``, has empty host and path and is a key
like any other; repeated rows get equal verdicts; an empty list allows everything; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from columnwright.llm.words import mix
from columnwright.storage import store

# Bytes of filter bits in one broadcast; a longer list is cut into slices by key hash.
SLICE_BYTES = 32_000_000
MAX_LEVELS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, below a path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; empty if null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; equal lengths: the first one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.text).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


@dataclass
class Level:
    """One Bloom filter: ``hashes`` bits of ``bits`` per key, at places that depend on ``salt``."""

    salt: int
    bits: int
    hashes: int
    words: np.ndarray = field(repr=False)

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bit places, one row per hash: double hashing, salted per level."""
        salt = np.uint64(self.salt)
        step = mix(b + salt) | np.uint64(1)
        start = mix(a ^ mix(np.full(1, salt, np.uint64)))
        return np.stack([mix(start + np.uint64(i) * step) % np.uint64(self.bits) for i in range(self.hashes)])

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for at in self.places(a, b):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


@dataclass
class Cascade:
    """Levels of one slice of the keys."""

    levels: list[Level]

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), len(self.levels) % 2 == 1)
        undecided = np.ones(len(a), bool)
        for i, level in enumerate(self.levels):
            missed = undecided & ~level.holds(a, b)
            out[missed] = i % 2 == 1
            undecided &= ~missed
        return out

    @property
    def bytes(self) -> int:
        return sum(level.words.nbytes for level in self.levels)


def key_hashes(key: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a key."""
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b")]


def _filtered(keys: DataFrame, level: Level) -> DataFrame:
    """The (a, b) rows that a level lets through."""
    sent = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.asarray(c).view(np.uint64) for c in batch.columns)
            yield batch.filter(pa.array(sent.value.holds(a, b)))

    return keys.mapInArrow(run, "a long, b long")


def bloom_level(keys: DataFrame, n: int, share: float, salt: int) -> Level:
    """Build a filter of ``n`` keys, rows (a, b), with a false positive rate of ``share``.

    Tasks turn keys into bit places; words of 64 bits are or-ed by Spark before they reach the
    driver, which holds the finished filter only.
    """
    share = min(max(share, 1e-6), 0.5)
    bits = max(64, int(math.ceil(n * math.log2(1 / share) / math.log(2))))
    level = Level(salt, bits, max(1, round(math.log2(1 / share))), np.zeros(-(-bits // 64), np.uint64))
    empty = Level(salt, bits, level.hashes, np.zeros(0, np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.asarray(c).view(np.uint64) for c in batch.columns)
            at = empty.places(a, b).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> np.uint64(6)).astype(np.int64)),
                 pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"]
            )

    words = keys.mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = words.toPandas()
    level.words[found["word"].to_numpy()] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return level


def build(universe: DataFrame, listed: DataFrame) -> Cascade:
    """The cascade for ``listed`` among ``universe``, both distinct (a, b) rows that are stored."""
    n, everything = listed.count(), universe.count()
    if not n:
        return Cascade([])
    # Level one: about as many others let through as keys are listed; later ones: one in two.
    levels = [bloom_level(listed, n, 0.5 * n / max(everything - n, 1), 1)]
    inside = listed
    caught = store(_filtered(universe, levels[0]).join(listed, ["a", "b"], "left_anti"), "caught")
    while True:
        m = caught.df.count()
        if not m:
            return Cascade(levels)
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("two keys share both hashes")
        levels.append(bloom_level(caught.df, m, 0.5, len(levels) + 1))
        inside, caught = caught.df, store(_filtered(inside, levels[-1]), "caught")


def blocked(keys: DataFrame, listed: DataFrame, key: str = "key", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``keys`` with a boolean ``listed``: whether the key is in the list, without a join.

    The list may be of any length: filters hold about two bytes per listed key, and a list
    that would need more than ``slice_bytes`` is cut into slices by key hash, each with a
    cascade and a pass of its own over the rows.
    """
    universe = keys.select(*key_hashes(F.col(key))).distinct()
    wanted = listed.select(*key_hashes(F.col(key))).distinct()
    wanted = store(wanted, "listed").df
    universe = store(universe.unionByName(wanted).distinct(), "universe").df
    slices = max(1, -(-wanted.count() * 4 // slice_bytes))
    names = keys.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema)
    out = None
    for s in range(slices):
        own = F.pmod(F.col("a"), F.lit(slices)) == s
        cascade = build(universe.where(own), wanted.where(own))
        sent = keys.sparkSession.sparkContext.broadcast(cascade)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (np.asarray(batch.column(i)).view(np.uint64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[2:], pa.array(sent.value.listed(a, b))], names=[*names, "listed"]
                )

        part = keys.select(*key_hashes(F.col(key)), *[F.col(f"`{c}`") for c in names]).where(own)
        part = part.mapInArrow(run, f"{kinds}, listed boolean")
        out = part if out is None else out.unionByName(part)
    return out


def judge(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    ``listed`` has a column ``key`` with addresses (host and path) to block. The longest rule
    decides; where none fits, the list does.
    """
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = parts.withColumn("key", F.concat("host", "path"))
    found = blocked(keyed, listed)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"))


def noticed_addresses(pages: DataFrame, notice: str) -> DataFrame:
    """``key`` (host and path) of every page whose HTML holds the notice; a null HTML holds none."""
    host, path = host_and_path(F.col("url"))
    return pages.where(F.contains("html", F.lit(notice))).select(F.concat(host, path).alias("key")).distinct()
