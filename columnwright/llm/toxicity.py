"""Toxicity by logistic regression, trained with FTRL-proximal on hashed n-grams.

Features are the hashed words, neighbouring pairs and pairs with one word skipped that occur in
a text (case folded, ASCII punctuation cut off). Every coordinate has its own learning rate, and the
L1 term keeps most weights at exactly zero, so the weights that go to the executors are a short
sparse vector of at most ``BUCKETS`` numbers.

Defined results: an empty or null text gets the score of the bias alone; a null ``doc_id``
counts as held out never and is scored like any other; repeated rows get equal scores; without
labels of both classes all scores are the share of label 1 (0 without any); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from columnwright.llm.words import PUNCTUATION, Chunk, chunks, mix

BUCKETS = 1 << 18
# Labelled rows that the model is fitted to, at most: the first ones in hash order.
SAMPLE_ROWS = 20_000
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.1
EPOCHS = 5
FOLDS = 5


@dataclass(frozen=True)
class SparseModel:
    """Non-zero weights of a logistic regression, and its bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS)
        out[self.index] = self.weight
        return out


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket), each pair once, sorted by text."""
    words, text = chunk.word_hashes(), chunk.text_of_words()
    keys, owners = [words], [text]
    for gap in (1, 2):
        if len(words) > gap:
            inside = text[gap:] == text[:-gap]
            pair = mix(words[:-gap] * np.uint64(2 * gap + 1) + words[gap:] + np.uint64(gap))
            keys.append(pair[inside])
            owners.append(text[gap:][inside])
    bucket = (np.concatenate(keys) % np.uint64(BUCKETS)).astype(np.int64)
    both = np.unique(np.concatenate(owners) * BUCKETS + bucket)
    return both // BUCKETS, both % BUCKETS


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> SparseModel:
    """One pass after another over (buckets, label) rows in the order given."""
    if not len(labels) or len(np.unique(labels)) < 2:
        share = float(np.mean(labels)) if len(labels) else 0.0
        bias = np.log((share + 1e-9) / (1 - share + 1e-9))
        return SparseModel(np.zeros(0, np.int64), np.zeros(0), float(bias))
    # The last place is the bias, which has no L1 term.
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zs, ns = z[at], n[at]
        shrink = np.sign(zs) * np.maximum(np.abs(zs) - L1, 0.0)
        return -shrink / ((BETA + np.sqrt(ns)) / ALPHA + L2)

    def bias() -> float:
        return -z[BUCKETS] / ((BETA + np.sqrt(n[BUCKETS])) / ALPHA)

    for _ in range(epochs):
        for at, y in zip(rows, labels):
            w, b = weights(at), bias()
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = p - y
            ns = n[at]
            z[at] += g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[at] = ns + g * g
            old = n[BUCKETS]
            z[BUCKETS] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / ALPHA * b
            n[BUCKETS] = old + g * g
    final = weights(slice(0, BUCKETS))
    index = np.flatnonzero(final)
    return SparseModel(index, final[index], float(bias()))


def held_out(doc_id=None):
    """Whether a row belongs to the part that no label is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id" if doc_id is None else doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> SparseModel:
    """Fit the model on at most ``sample_rows`` labelled rows that are not held out.

    The sample is trained on by one task, in hash order; its size does not depend on the table.
    """
    at = F.xxhash64(F.col("doc_id").cast("string"))
    picked = (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
        .orderBy(at, "doc_id").limit(sample_rows)
    )
    # At most sample_rows ids are broadcast.
    sample = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(
        at.alias("__at"), "__toxic", "text"
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, chunk in chunks(batch.column(2), separators=PUNCTUATION, lower=True):
                text, bucket = features(chunk)
                cuts = np.searchsorted(text, np.arange(chunk.texts + 1))
                own = bucket.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first),
                     pa.array([own[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())],
                    names=["at", "toxic", "buckets"],
                )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            labels += batch.column(1).to_pylist()
            rows += [np.frombuffer(x.as_py(), np.int32) for x in batch.column(2)]
        model = ftrl(rows, np.array(labels, float))
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *model.index.tolist()], pa.int64()), pa.array([model.bias, *model.weight.tolist()], pa.float64())],
            names=["bucket", "weight"],
        )

    found = (
        sample.mapInArrow(extract, "at long, toxic int, buckets binary")
        .repartition(1).sortWithinPartitions("at", "toxic", "buckets")
        .mapInArrow(learn, "bucket long, weight double").collect()
    )
    found = sorted((r["bucket"], r["weight"]) for r in found)
    if not found:
        return ftrl([], np.zeros(0))
    return SparseModel(np.array([b for b, _ in found[1:]], np.int64), np.array([w for _, w in found[1:]]), found[0][1])


def score(documents: DataFrame, model: SparseModel) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, in one pass."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = sent.value.dense(), sent.value.bias
        for batch in batches:
            for first, last, chunk in chunks(batch.column(2), separators=PUNCTUATION, lower=True):
                text, bucket = features(chunk)
                total = np.bincount(text, weights=table[bucket], minlength=chunk.texts) + bias
                p = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first),
                     pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return documents.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def classify(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Train on the labelled rows that are not held out, score every row."""
    return score(documents, train(documents, labels, sample_rows))
