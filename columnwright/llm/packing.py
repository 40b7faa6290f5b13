"""Packing token sequences by Karmarkar-Karp multiway differencing.

Each task packs its own documents in groups of about ``GROUP_WINDOWS`` windows' worth of
tokens, whatever the table. Inside a group, stretches of a whole window are cut off long
documents first; what is left is cut into pieces of at most ``PIECE`` ids. Multiway differencing then deals the pieces to windows: partial partitions are
tuples of window sums; the two with the largest spread are merged again and again, the fullest
windows of one with the emptiest of the other, until one partition is left whose windows are
nearly equal. It starts with the least number of windows that could do; the number rises
whenever the fullest window exceeds the capacity.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from columnwright.llm.tokens import encoder, tokenizer_path, with_end
from columnwright.llm.words import text_column
from columnwright.storage import store

CAPACITY = 1_024
PIECE = 256
GROUP_WINDOWS = 128


def differencing(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each size, sum of each window) by multiway differencing; ties by position.

    A partial partition is a vector of window sums, ascending, less its least sum; merging
    adds one vector to the reverse of the other. The pieces behind each entry are chained
    through parent links, so a merge costs one sort of ``windows`` numbers.
    """
    n = len(sizes)
    if windows <= 1 or n == 0:
        return np.zeros(n, np.int64), np.bincount(np.zeros(n, np.int64), sizes, max(windows, 1))
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}
    # owner[p][w]: node of the piece tree that stands in window w; -1 for none.
    owner: dict[int, np.ndarray] = {}
    next_id = n

    def whole(i: int) -> tuple[np.ndarray, np.ndarray]:
        if i in sums:
            return sums.pop(i), owner.pop(i)
        vector = np.zeros(windows, np.int64)
        vector[-1] = sizes[i]
        own = np.full(windows, -1, np.int64)
        own[-1] = i
        return vector, own

    joined: list[tuple[np.ndarray, np.ndarray, int]] = []
    count = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        va, oa = whole(a)
        vb, ob = whole(b)
        ob = ob[::-1]
        total = va + vb[::-1]
        both = (oa >= 0) & (ob >= 0)
        merged = np.where(oa >= 0, oa, ob)
        m = int(np.count_nonzero(both))
        if m:
            joined.append((oa[both], ob[both], count))
            merged[both] = np.arange(count, count + m)
            count += m
        order = np.argsort(total, kind="stable")
        total, merged = total[order], merged[order]
        total = total - total[0]
        sums[next_id], owner[next_id] = total, merged
        heapq.heappush(heap, (-int(total[-1]), next_id))
        next_id += 1
    _, top = heap[0]
    _, own = whole(top)
    window = np.full(count, -1, np.int64)
    held = own >= 0
    window[own[held]] = np.flatnonzero(held)
    for a, b, first in reversed(joined):
        window[a] = window[b] = window[first : first + len(a)]
    window = window[:n]
    return window, np.bincount(window, sizes, windows)


def cut(lengths: np.ndarray, capacity: int = CAPACITY, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces: whole windows first, then even shares up to ``piece``."""
    whole = lengths // capacity
    rest = lengths - whole * capacity
    shares = -(-rest // piece)
    per = whole + shares
    doc = np.repeat(np.arange(len(lengths)), per)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    w, r, s = whole[doc], rest[doc], np.maximum(shares[doc], 1)
    j = k - w
    start = np.where(j < 0, k * capacity, w * capacity + j * r // s)
    length = np.where(j < 0, capacity, (j + 1) * r // s - j * r // s)
    return doc, start, length


def pack_group(lengths: np.ndarray, capacity: int = CAPACITY, piece: int = PIECE) -> dict[str, np.ndarray]:
    """Pieces of some documents with their window and offset; windows are numbered from 0."""
    doc, start, length = cut(np.asarray(lengths, np.int64), capacity, piece)
    window = np.zeros(len(doc), np.int64)
    full = length == capacity
    n_full = int(full.sum())
    window[full] = np.arange(n_full)
    loose = np.flatnonzero(~full)
    if len(loose):
        wanted = -(-int(length[loose].sum()) // capacity)
        while True:
            dealt, sums = differencing(length[loose], wanted)
            if sums.max() <= capacity:
                break
            wanted += 1
        used = np.cumsum(sums > 0) - 1
        window[loose] = n_full + used[dealt]
    order = np.lexsort((start, doc, window))
    offset = np.zeros(len(doc), np.int64)
    sizes = length[order]
    before = np.cumsum(sizes) - sizes
    first = np.flatnonzero(np.diff(window[order], prepend=-1))
    offset[order] = before - np.repeat(before[first], np.diff(np.append(first, len(order))))
    return {"doc": doc, "start": start, "length": length, "window": window, "offset": offset}


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(documents: DataFrame, tokenizer: str | None = None, end_id: int = 0,
                   capacity: int = CAPACITY, piece: int = PIECE, group_windows: int = GROUP_WINDOWS,
                   with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``with_ids`` adds the ids (little-endian, unsigned, 32 bits). Each task packs its own
    rows group by group as they come, with no shuffle: a group is the next documents with
    ``group_windows`` windows of tokens, and the pieces are written before sequences are
    numbered, so a retried task cannot disagree with rows that were read already. Sequence
    ids are unique: the task's number in the upper bits, the window's in the lower 40.

    A null text is empty (the end id alone); null and repeated ids are packed like others; a
    text of any length fills whole windows first; an empty table has no pieces.
    """
    import zlib

    path = tokenizer or tokenizer_path()
    kind = documents.schema["doc_id"].dataType.simpleString()
    limit = group_windows * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        next_window = (context.partitionId() if context else 0) << 40
        tool = encoder(path)
        waiting_ids: list[pa.Array] = []
        waiting: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal next_window, size
            lengths = np.array([len(x) for x in waiting], np.int64)
            packed = pack_group(lengths, capacity, piece)
            doc, start, length = packed["doc"], packed["start"], packed["length"]
            raw = [memoryview(waiting[d])[s : s + n] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())]
            names = pa.concat_arrays(waiting_ids).take(pa.array(doc))
            columns = [
                names, pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                pa.array(lengths[doc]), pa.array(next_window + packed["window"]), pa.array(packed["offset"]),
            ]
            if with_ids:
                columns.append(pa.array([bytes(x) for x in raw], pa.binary()))
            next_window += int(packed["window"].max()) + 1
            waiting.clear()
            waiting_ids.clear()
            size = 0
            return pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                + ["ids"] * with_ids,
            )

        for batch in batches:
            texts = text_column(batch.column(1)).to_pylist()
            for first, last, ids, offsets in tool.encode(texts):
                ids, offsets = with_end(ids, offsets, end_id)
                ids = ids.astype("<u4", copy=False)
                at = 0
                while at < last - first:
                    upto = int(np.searchsorted(offsets, offsets[at] + max(limit - size, 1)))
                    upto = min(max(upto, at + 1), last - first)
                    waiting += [ids[a:b] for a, b in zip(offsets[at:upto], offsets[at + 1 : upto + 1])]
                    waiting_ids.append(batch.column(0).slice(first + at, upto - at))
                    size += int(offsets[upto] - offsets[at])
                    at = upto
                    if size >= limit:
                        yield flush()
        if waiting:
            yield flush()

    schema = f"doc_id {kind}, {PIECES}" + ", ids binary" * with_ids
    pieces = documents.select("doc_id", "text").mapInArrow(run, schema)
    return store(pieces, "pieces").df


def padding(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequences, ids and padding of a packing; a sequence whose length is a power of two has none."""
    lengths = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    padded = F.when(F.col("n").bitwiseAND(F.col("n") - 1) == 0, F.lit(0)).otherwise(capacity - F.col("n"))
    return lengths.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("ids"), F.sum(padded).alias("padding"))
