"""Quality classifier by importance resampling with hashed n-gram models.

Two bag-of-n-grams models over hashed buckets are counted from all rows: the target model
from the documents labelled good, the raw model from every document. The log ratio of the two
models over the n-grams of a text is its importance; Gumbel noise from a hash of the id is
added, and the ``k`` largest sums are a sample without replacement in proportion to the
importances.

Defined results: an empty or null text has importance zero; the same id always draws the same
noise, null ids the noise of the empty id; rows that tie at the border are all kept; without
labelled rows every importance is zero; a very long text makes a chunk of its own; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from columnwright.llm.urls import bloom_level, key_hashes
from columnwright.llm.words import Chunk, chunks, mix
from columnwright.operators.ordering import exact_quantiles
from columnwright.storage import store

BUCKETS = 1 << 14
SEED = 2024
# Ids and false positive rate that the filter before the join with the good ids is made for.
# Its size (4 MB) is the same for any number of labels; more ids let more rows through.
FILTER_IDS, FILTER_SHARE = 4_000_000, 1 / 64


def grams(chunk: Chunk, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and every pair of neighbouring words."""
    words, text = chunk.word_hashes(), chunk.text_of_words()
    pairs = mix(words[:-1] * np.uint64(3) + words[1:])
    inside = text[1:] == text[:-1]
    keys = np.concatenate([words, pairs[inside]])
    return np.concatenate([text, text[1:][inside]]), (keys % np.uint64(buckets)).astype(np.int64)


def good_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``text`` of the documents that any label row of their id calls good.

    A Bloom filter of fixed size keeps most other texts out of the shuffle; the join that
    follows is exact, and the same at every size.
    """
    ids = labels.where("doc_id IS NOT NULL AND quality = 1").select("doc_id")
    level = documents.sparkSession.sparkContext.broadcast(
        bloom_level(ids.distinct().select(*key_hashes(F.col("doc_id"))), FILTER_IDS, FILTER_SHARE, 1)
    )
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.asarray(batch.column(i)).view(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(batch.columns[2:], names=["doc_id", "text"]).filter(pa.array(level.value.holds(a, b)))

    # Hashes stand for equal ids only if both sides have one type.
    named = documents.where("doc_id IS NOT NULL").select(
        *key_hashes(F.col("doc_id").cast(labels.schema["doc_id"].dataType)), "doc_id", "text"
    )
    likely = named.mapInArrow(run, f"doc_id {kind}, text string")
    return likely.join(ids.hint("merge"), "doc_id", "left_semi").select("text")


def count_grams(documents: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts per bucket over the ``text`` of all rows.

    Every task adds up its own rows first, so at most ``buckets`` rows a task are shuffled and
    ``buckets`` rows reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, chunk in chunks(batch.column(0), lower=True):
                own += np.bincount(grams(chunk, buckets)[1], minlength=buckets)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at])], names=["bucket", "n"])

    found = documents.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for r in found.collect():
        counts[r["bucket"]] = r["n"]
    return counts


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """Log of target over raw probability per bucket from counts (raw, target), one added to each."""
    if not counts[1].sum():
        return np.zeros(counts.shape[1])
    share = (counts + 1.0) / (counts.sum(1, keepdims=True) + counts.shape[1])
    return np.log(share[1]) - np.log(share[0])


def score(documents: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id and ``importance`` (sum of log ratios) of every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    weights = documents.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for batch in batches:
            for first, last, chunk in chunks(batch.column(1), lower=True):
                text, bucket = grams(chunk, len(table))
                sums = np.bincount(text, weights=table[bucket], minlength=chunk.texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(sums)], names=["doc_id", "importance"]
                )

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, importance double")


def resample(documents: DataFrame, labels: DataFrame, share: float | None = None,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, importance, gumbel_key and ``kept`` of every row.

    ``share`` of the rows is kept; by default the share of good rows among the labelled ones.
    A document counts as good if any label row of its id says so. The threshold is exact: it
    lies between the k-th and the next key, found by counting ranges, not by a global sort. If
    these keys are equal, all rows with that key are kept.
    """
    if share is None:
        rated = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        by_doc = rated.groupBy("doc_id").agg(F.max("quality").alias("__good"))
        share = by_doc.agg(F.avg("__good")).first()[0]
        share = 1.0 if share is None else share
    target = count_grams(good_documents(documents, labels), buckets)
    ratio = log_ratio(np.stack([count_grams(documents, buckets), target]))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 11)
    uniform = (unit + F.lit(0.5)) / F.lit(float(1 << 53))
    scored = store(
        score(documents, ratio).withColumn("gumbel_key", F.col("importance") - F.log(-F.log(uniform))), "importance"
    ).df
    n = scored.count()
    k = math.floor(share * n + 0.5)
    if k >= n or n < 2:
        keep = F.lit(k >= 1)
    elif k <= 0:
        keep = F.lit(False)
    else:
        # Half-way between the ranks n-k-1 and n-k, so rounding cannot cross either; if both have one
        # key, that key.
        keep = F.col("gumbel_key") >= exact_quantiles(scored, "gumbel_key", [(n - k - 0.5) / (n - 1)])[0]
    return scored.select("doc_id", "importance", "gumbel_key", keep.alias("kept"))
