"""Ranked lexical search by a dual-tree walk over items and documents.

Whole texts are read once: each document becomes its number of terms and the (term, count) pairs
of those terms that occur in an item. Document frequencies and totals come from that table.

A task then walks its documents in batches. The documents of a batch form a tree: groups of
``LEAF_DOCS`` alike documents below groups of ``NODE_DOCS``; the items form one of groups of
``LEAF_ITEMS`` alike items. A node holds the maximum of each coordinate (a term's share of the
score in a document, its weight times its number of occurrences in an item). The product of two
nodes bounds the score of every pair below them; if it is below the weakest k-th score of the
items so far, the whole pair of groups is left out. The bound is never too low, so the result is
exact. The k-th scores start from those of a few documents, which are lower bounds for all.

All scores are whole numbers. Products run in doubles while every sum stays below 2^53, which
makes them exact, and in 64-bit integers beyond that.

Items are taken in groups of at most ``ITEM_BYTES``, one group after the other, so any number of
items can be ranked and what is broadcast for a group has a bound (one longer item is a group of
its own).

Defined results: a null or empty text has no term and is never found; an item without terms, or
whose terms occur nowhere, has no row; equal (item_id, text) rows are one item, different texts
of one ``item_id`` are ranked apart; every row of ``documents`` is ranked on its own, repeated
ids too; equal scores go by ascending ``doc_id``, null ids first; a very long text makes a chunk
of its own; empty tables give an empty table; other columns are ignored. Terms are told apart by
64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from columnwright.llm.words import chunks
from columnwright.storage import scratch, store

K = 10
ITEM_BYTES = 4_000_000
# Items whose terms are laid out side by side, and numbers in the matrix of a batch, at most.
BLOCK_ITEMS, BLOCK_TERMS, CELLS = 256, 8_192, 4_000_000
LEAF_ITEMS, LEAF_DOCS, NODE_DOCS = 8, 16, 128
SEED_DOCS = 20_000
# ASCII but letters and digits stands between terms; bytes of longer sequences are parts of terms.
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
EXACT = float(1 << 53)
HITS = "doc_id long, n long, terms array<int>, counts array<int>"


@dataclass(frozen=True)
class Items:
    """Some items and the hashes of their terms, sorted."""

    ids: list
    terms: list[np.ndarray]  # places in ``vocabulary`` per item, each once
    counts: list[np.ndarray]
    vocabulary: np.ndarray


def item_groups(items: DataFrame, limit: int = ITEM_BYTES) -> Iterator[Items]:
    """The distinct items in groups of bounded size; the driver holds one group at a time."""
    rows = items.select("item_id", "text").where("text IS NOT NULL").distinct()
    held, size = [], 0
    for r in rows.toLocalIterator():
        own = len(r["text"].encode())
        if held and size + own > limit:
            yield _items(held)
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += own
    if held:
        yield _items(held)


def _items(rows: list[tuple]) -> Items:
    ids, terms, counts = [], [], []
    at = 0
    for _, _, chunk in chunks(pa.array([t for _, t in rows], pa.string()), separators=BETWEEN, lower=True):
        words = chunk.word_hashes()
        for i in range(chunk.texts):
            own, n = np.unique(words[chunk.word_at[i] : chunk.word_at[i + 1]], return_counts=True)
            if len(own):
                ids.append(rows[at][0])
                terms.append(own)
                counts.append(n)
            at += 1
    vocabulary = np.unique(np.concatenate(terms)) if terms else np.zeros(0, np.uint64)
    return Items(ids, [np.searchsorted(vocabulary, t) for t in terms], counts, vocabulary)


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """One list per owner (sorted) of ``n``."""
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(owner, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def hits(documents: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n, terms, counts of every document with a term; terms are places in ``vocabulary``."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for first, last, chunk in chunks(batch.column(1), separators=BETWEEN, lower=True):
                words, text = chunk.word_hashes(), chunk.text_of_words()
                place = np.minimum(np.searchsorted(known, words), len(known) - 1)
                found = known[place] == words
                pairs, n = np.unique(text[found] * len(known) + place[found], return_counts=True)
                owner, term = pairs // len(known), pairs % len(known)
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(chunk.n_words.astype(np.int64)),
                     _lists(owner, term, chunk.texts), _lists(owner, n, chunk.texts)],
                    names=["doc_id", "n", "terms", "counts"],
                )
                yield out.filter(pa.array(chunk.n_words > 0))

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, HITS)


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(doc_id column, n, row of each pair, term, count) of a batch of hits."""
    terms, counts = batch.column(2), batch.column(3)
    rows = np.repeat(np.arange(len(batch)), np.asarray(terms.value_lengths()))
    return np.asarray(batch.column(1)), rows, np.asarray(terms.flatten()), np.asarray(counts.flatten())


def frequencies(found: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary occurs; every task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, np.int64)
        for batch in batches:
            own += np.bincount(np.asarray(batch.column(0).flatten()), minlength=size)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at])], names=["term", "df"])

    rows = found.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r["term"]] = r["df"]
    return out


class Search:
    """The best ``k`` documents of some items among the documents it is shown."""

    def __init__(self, items: Items, weights: np.ndarray, documents: int, terms: int, floor: np.ndarray, k: int) -> None:
        self.documents, self.terms, self.k, self.size = documents, terms, k, len(items.vocabulary)
        self.floor = floor.copy()
        self.best: list[list[tuple]] = [[] for _ in items.ids]  # (-score, has id, id), sorted
        self.scored = self.pairs = 0
        # Alike items stand together: those that share their heaviest terms.
        heavy = [tuple(t[np.argsort(-weights[t], kind="stable")][:3]) for t in items.terms]
        order = sorted(range(len(items.ids)), key=lambda i: heavy[i])
        self.blocks = []
        at = 0
        while at < len(order):
            own, seen = [], set()
            while at < len(order) and len(own) < BLOCK_ITEMS:
                more = seen | set(items.terms[order[at]].tolist())
                if own and len(more) > BLOCK_TERMS:
                    break
                own.append(order[at])
                seen, at = more, at + 1
            columns = np.array(sorted(seen))
            demand = np.zeros((len(own), len(columns)), np.int64)
            for row, i in enumerate(own):
                demand[row, np.searchsorted(columns, items.terms[i])] = items.counts[i] * weights[items.terms[i]]
            # No document gives a term more than 10^6.
            kind = np.float64 if demand.sum(1).max() * 1e6 < EXACT else np.int64
            demand = demand.astype(kind)
            starts = np.arange(0, len(own), LEAF_ITEMS)
            self.blocks.append((np.array(own), columns, demand, np.maximum.reduceat(demand, starts), starts))

    def show(self, ids: list, n: np.ndarray, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        """Rank a batch of documents, given as (row, term, count) sorted by row."""
        m = np.array([25 + 75 * int(x) * self.documents // self.terms for x in n.tolist()], np.int64)
        tf = counts.astype(np.int64)
        supply = 1_000_000_000 * tf // (1000 * tf + 8 * m[rows])
        for block in self.blocks:
            columns = block[1]
            place = np.minimum(np.searchsorted(columns, terms), len(columns) - 1)
            held = columns[place] == terms
            step = max(LEAF_DOCS, CELLS // len(columns))
            for first in range(0, len(n), step):
                part = held & (rows >= first) & (rows < first + step)
                used, row = np.unique(rows[part], return_inverse=True)
                if len(used):
                    matrix = np.zeros((len(used), len(columns)), block[2].dtype)
                    matrix[row, place[part]] = supply[part]
                    self._walk(block, matrix, used, ids)

    def _walk(self, block: tuple, docs: np.ndarray, rows: np.ndarray, ids: list) -> None:
        own, _, demand, groups, starts = block
        # Documents that serve the same group of items best, and as well, stand together.
        near = docs @ groups.T
        nearest = near.argmax(1)
        order = np.lexsort([-near[np.arange(len(docs)), nearest], nearest])
        docs, rows = docs[order], rows[order]
        leaves = np.arange(0, len(docs), LEAF_DOCS)
        tops = np.maximum.reduceat(docs, leaves)
        step = NODE_DOCS // LEAF_DOCS
        nodes = np.arange(0, len(leaves), step)
        self.pairs += len(docs) * len(own)
        weakest = np.minimum.reduceat(self.floor[own], starts)
        upper = groups @ np.maximum.reduceat(tops, nodes).T
        # The best pairs first: they raise the k-th scores that cut off the others.
        for g, node in sorted(zip(*np.nonzero(upper >= weakest[:, None])), key=lambda x: -upper[x]):
            some = slice(starts[g], starts[g] + LEAF_ITEMS)
            if upper[g, node] < self.floor[own[some]].min():
                continue
            below = slice(nodes[node], nodes[node] + step)
            bound = demand[some] @ tops[below].T
            floor = self.floor[own[some]]
            alive = np.flatnonzero((bound >= floor[:, None]).any(0))
            for leaf in (alive + nodes[node])[np.argsort(-bound[:, alive].max(0), kind="stable")].tolist():
                floor = self.floor[own[some]]
                live = np.flatnonzero(bound[:, leaf - nodes[node]] >= floor)
                if len(live):
                    self._score(own[some][live], demand[some][live], docs, rows, slice(leaves[leaf], leaves[leaf] + LEAF_DOCS), ids)

    def _score(self, items: np.ndarray, demand: np.ndarray, docs: np.ndarray, rows: np.ndarray, leaf: slice, ids: list) -> None:
        scores = demand @ docs[leaf].T
        self.scored += scores.size
        good = (scores >= self.floor[items][:, None]) & (scores > 0)
        for i, d in zip(*np.nonzero(good)):
            item, doc = items[i], ids[rows[leaf][d]]
            entry = (-int(scores[i, d]), doc is not None, doc or 0)
            best = self.best[item]
            if len(best) < self.k or entry < best[-1]:
                best.append(entry)
                best.sort()
                del best[self.k :]
                if len(best) == self.k:
                    self.floor[item] = max(self.floor[item], -best[-1][0])

    def found(self) -> pa.RecordBatch:
        rows = [(i, e[2] if e[1] else None, -e[0]) for i, best in enumerate(self.best) for e in best]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))],
            names=["item", "doc_id", "score"],
        )


def _search(found: DataFrame, items: Items, weights: np.ndarray, documents: int, terms: int, floor: np.ndarray, k: int) -> DataFrame:
    """item (number in the group), doc_id, score: at most ``k`` rows per item and task."""
    shared = found.sparkSession.sparkContext.broadcast((items, weights, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight, least = shared.value
        search = Search(own, weight, documents, terms, least, k)
        for batch in batches:
            search.show(batch.column(0).to_pylist(), *_pairs(batch))
        yield search.found()

    return found.where(F.size("terms") > 0).mapInArrow(run, "item int, doc_id long, score long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    along = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    return rows.withColumn("rank", F.row_number().over(along)).where(F.col("rank") <= k)


def rank(documents: DataFrame, items: DataFrame, k: int = K, seed_docs: int = SEED_DOCS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of every item.

    ``seed_docs`` says how many documents are looked at first; it changes how much is left out
    of the walk, never the result.
    """
    spark = documents.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    parts = []
    for group in item_groups(items):
        with scratch():
            part = store(_ranked(documents, group, kind, k, seed_docs), "ranked")
            part.keep()
        parts.append(part.df)
    if not parts:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _ranked(documents: DataFrame, group: Items, kind: str, k: int, seed_docs: int) -> DataFrame:
    spark = documents.sparkSession
    size = len(group.vocabulary)
    if not size:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    found = store(hits(documents, group.vocabulary), "hits").df
    total = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n, length = total[0], total[1]
    df = frequencies(found, size)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    weights[df == 0] = 0  # occurs nowhere
    floor = np.ones(len(group.ids), np.int64)  # scores are above zero
    if n > seed_docs:
        few = found.sample(min(1.0, seed_docs / n), seed=1)
        for r in _best(_search(few, group, weights, n, length, floor, k), k).where(F.col("rank") == k).collect():
            floor[r["item"]] = r["score"]
    best = _best(_search(found, group, weights, n, length, floor, k), k)
    names = spark.createDataFrame(list(enumerate(group.ids)), f"item int, item_id {kind}")
    return best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
