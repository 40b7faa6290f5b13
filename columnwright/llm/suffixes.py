"""Suffix-array dedup: every byte covered by a long string that starts anywhere else is removed.

Sorting all suffixes of a corpus would move every byte hundreds of times. Here only sampled
suffixes are sorted, and the result is still exact to the byte:

* Anchors. In every window of ``length`` bytes the least hash of its ``KMER``-byte strings
  marks one position (the leftmost of equal ones). Equal windows mark the same place, so two
  copies of a ``length``-byte string always share an anchor with the same hash. Anchors whose
  hash occurs at one place only are dropped by a count.
* Contexts. A window that holds an anchor lies within ``REACH`` bytes before it and ``length``
  bytes after it. Anchors with identical contexts at different places are covered whole;
  distinct contexts are kept once, so copies of a text do not multiply anything.
* Merge. The distinct contexts are sorted as suffixes from their anchors on: every task sends
  sorted, front-coded runs, and one task per bucket of anchor hashes merges the runs with a
  loser tree that compares only beyond the prefixes it already knows. The common prefix
  lengths that come out give, for every offset of a window around the anchor, the contexts
  with equal bytes after the anchor; the bytes before it are compared by a running hash.
* An anchor hash with more than ``HOT_CONTEXTS`` different contexts is not merged in one task:
  its windows are hashed and counted by Spark instead, with the same result.

Strings are judged on the input, the same document included; matches never cross documents.
Texts are shuffled twice: to their candidate anchors and to their spans.

Defined results: a null text is empty; a repeated row is a copy of its text like any other, so
all of a copied text goes if it has ``length`` bytes; ids may be null or repeated; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from columnwright.llm.words import INVERSE, BASE, mix, powers, repeated, spans as text_spans, text_bytes
from columnwright.storage import store

LENGTH = 400
KMER = 128
HOT_CONTEXTS = 100_000
BUCKET_CONTEXTS = 20_000
CHUNK_BYTES = 500_000
# Places of a block of windows fit into this many bits of a sort key.
PLACE_BITS = 22


def text_key() -> list[Column]:
    """Two 64-bit hashes that stand for a text."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(3), text).alias("t2")]


# -- anchors ------------------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of some texts laid end to end, ascending."""
    n, width = len(data), length - kmer + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    hashes = mix((sums[kmer:] - sums[:-kmer]) * powers(INVERSE, n + 1)[: n + 1 - kmer])
    ends = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.arange(n - length + 1)
    inside = starts + length <= ends[: n - length + 1]
    found = []
    block = (1 << PLACE_BITS) - width
    for low in range(0, len(starts), block):
        high = min(low + block, len(starts))
        own = hashes[low : high + width - 1]
        keys = (own >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(own), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            keys = np.minimum(keys[:-size], keys[size:])
            size *= 2
        least = np.minimum(keys[: high - low], keys[width - size : width - size + high - low])
        place = (least[inside[low:high]] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        if len(place):
            found.append(low + place[np.flatnonzero(np.diff(place, prepend=-1))])
    at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return at, hashes[at]


def anchor_table(documents: DataFrame, length: int, kmer: int) -> DataFrame:
    """t1, t2, pos, h of every anchor of every row (``documents``: t1, t2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            data, offsets = text_bytes(batch.column(2))
            for first, last in text_spans(offsets, CHUNK_BYTES):
                own = offsets[first : last + 1] - offsets[first]
                at, h = anchors(data[offsets[first] : offsets[last]], own, length, kmer)
                text = np.searchsorted(own, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t1[first:last][text]), pa.array(t2[first:last][text]), pa.array(at - own[text]), pa.array(h.view(np.int64))],
                    names=["t1", "t2", "pos", "h"],
                )

    return documents.mapInArrow(run, "t1 long, t2 long, pos long, h long")


def context_table(rows: DataFrame, length: int, kmer: int) -> DataFrame:
    """One row per candidate anchor: h, its place, the context's hash, sizes and bytes.

    ``rows``: t1, t2, text, found (array of pos and h). The bytes of a context are null where
    the same task's batch has sent them already.
    """
    reach = length - kmer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            sent: set[bytes] = set()
            t1, t2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts, found = batch.column(2), batch.column(3).to_pylist()
            out: list[tuple] = []
            for i, marks in enumerate(found):
                text = (texts[i].as_py() or "").encode()
                for mark in marks:
                    p = mark["pos"]
                    low = max(0, p - reach)
                    context = text[low : p + length]
                    left = p - low
                    name = digest(context, left)
                    out.append((mark["h"], t1[i], t2[i], p, name, left, len(context) - left, None if name in sent else context))
                    sent.add(name)
                if len(out) > 5_000 or (out and i == len(found) - 1):
                    columns = list(zip(*out))
                    names = np.frombuffer(b"".join(columns[4]), "<i8").reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()),
                         pa.array(columns[5], pa.int32()), pa.array(columns[6], pa.int32()), pa.array(columns[7], pa.binary())],
                        names=["h", "t1", "t2", "pos", "c1", "c2", "before", "after", "context"],
                    )
                    out = []

    return rows.mapInArrow(
        run, "h long, t1 long, t2 long, pos long, c1 long, c2 long, before int, after int, context binary"
    )


# -- front-coded runs and their merge -----------------------------------------------------


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that agree in the first ``known`` bytes."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, high = known, n  # agree before low, differ before high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def front_code(items: Sequence[bytes]) -> tuple[list[int], list[bytes]]:
    """Shared prefix with the item before, and the rest, of sorted strings."""
    shared, rest, last = [], [], b""
    for item in items:
        n = common_prefix(last, item)
        shared.append(n)
        rest.append(item[n:])
        last = item
    return shared, rest


def front_decode(shared: Sequence[int], rest: Sequence[bytes]) -> list[bytes]:
    out, last = [], b""
    for n, tail in zip(shared, rest):
        last = last[:n] + tail
        out.append(last)
    return out


def merge_runs(runs: Sequence[tuple[Sequence[int], Sequence[bytes]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted front-coded runs: (run, item) in order, and common prefixes with the item before.

    A loser tree: every inner node keeps the run that lost there, every run the length of the
    prefix that its first item shares with the item put out last. Of two runs the one that
    shares more goes first; only if both share the same are bytes compared, from there on.
    """
    items = [front_decode(*run) for run in runs]
    shared = [list(run[0]) for run in runs]
    k = len(runs)
    place = [0] * k
    known = [0] * k  # of each run's first item with the last item put out
    live = [len(x) > 0 for x in items]
    losers = [-1] * max(k, 1)

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes the one with the winner if they tie."""
        if not live[a]:
            return b, a
        if not live[b]:
            return a, b
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = items[a][place[a]], items[b][place[b]]
        n = common_prefix(x, y, known[a])
        first = n == len(x) if n == len(x) or n == len(y) else x[n] < y[n]
        if n == len(x) == len(y):
            first = a < b
        winner, loser = (a, b) if first else (b, a)
        known[loser] = n
        return winner, loser

    # Leaves are k .. 2k-1; node i has the children 2i and 2i+1; the champion leaves at node 1.
    champion = list(range(-k, k))
    for i in range(2 * k - 1, k - 1, -1):
        champion[i] = i - k
    for i in range(k - 1, 0, -1):
        champion[i], losers[i] = play(champion[2 * i], champion[2 * i + 1])
    order, prefixes = [], []
    top = champion[1] if k > 1 else 0
    while k and live[top]:
        order.append((top, place[top]))
        prefixes.append(known[top])
        place[top] += 1
        if place[top] < len(items[top]):
            known[top] = shared[top][place[top]]
        else:
            live[top] = False
        node = (top + k) // 2
        while node >= 1 and k > 1:
            top, losers[node] = play(top, losers[node])
            node //= 2
    return order, prefixes


def covered_offsets(prefixes: np.ndarray, lefts: Sequence[bytes], rights: np.ndarray, length: int, kmer: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes before, bytes after the anchor) that repeated windows cover, per sorted context.

    ``prefixes``: common prefix with the context before; ``rights``: bytes after the anchor.
    For a window that starts ``d`` bytes before the anchor, contexts with ``length - d`` equal
    bytes after it are neighbours in the order; those with ``d`` equal bytes before it too are
    repeats. Both cover the anchor, so their union is one stretch.
    """
    n, reach = len(lefts), length - kmer
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    sizes = np.fromiter(map(len, lefts), np.int64, n)
    reversed_ = np.zeros((n, reach), np.uint8)
    for i, left in enumerate(lefts):
        reversed_[i, : len(left)] = np.frombuffer(left, np.uint8)[::-1]
    sums = np.zeros(n, np.uint64)
    power = powers(BASE, reach + 1)
    for d in range(reach + 1):
        if d:
            sums += (reversed_[:, d - 1].astype(np.uint64) + np.uint64(1)) * power[d]
        need = length - d
        can = np.flatnonzero((sizes >= d) & (rights >= need))
        if len(can) < 2:
            continue
        same_after = np.cumsum(prefixes < need)
        keys = mix(sums[can] + mix(same_after[can].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
        hit = can[repeated(keys)]
        before[hit] = d  # d ascends
        fresh = hit[after[hit] == 0]
        after[fresh] = need
    return before, after


def merged_answers(contexts: DataFrame, buckets: int, length: int, kmer: int) -> DataFrame:
    """c1, c2 and the stretch (lo, hi) around the anchor that repeated windows cover.

    ``contexts``: h, c1, c2, before, context, each context once. Tasks exchange front-coded
    sorted runs, one per bucket and batch; a bucket's runs are merged by one task.
    """

    def to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c1, c2, before = (np.asarray(batch.column(i)) for i in range(4))
            raw = batch.column(4).to_pylist()
            bucket = h % buckets
            rights = [x[b:] for x, b in zip(raw, before.tolist())]
            lefts = [x[:b] for x, b in zip(raw, before.tolist())]
            for k in np.unique(bucket).tolist():
                at = sorted(np.flatnonzero(bucket == k).tolist(), key=rights.__getitem__)
                shared, rest = front_code([rights[i] for i in at])
                values = [
                    [k], [c1[at].tolist()], [c2[at].tolist()], [shared], [[len(x) for x in rest]], [b"".join(rest)],
                    [[len(lefts[i]) for i in at]], [b"".join(lefts[i] for i in at)],
                ]
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()),
                         pa.binary(), pa.list_(pa.int32()), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(values, kinds)],
                    names=["bucket", "c1", "c2", "shared", "sizes", "rest", "lefts", "left"],
                )

    def cut(data: bytes, sizes) -> list[bytes]:
        ends = np.cumsum(sizes).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        runs, lefts, c1, c2 = [], [], [], []
        for row in group.itertuples(index=False):
            runs.append((list(map(int, row.shared)), cut(row.rest, row.sizes)))
            lefts.append(cut(row.left, row.lefts))
            c1.append(row.c1)
            c2.append(row.c2)
        order, prefixes = merge_runs(runs)
        sizes = [[n + len(t) for n, t in zip(*run)] for run in runs]
        lo, hi = covered_offsets(
            np.array(prefixes, np.int64), [lefts[r][i] for r, i in order],
            np.array([sizes[r][i] for r, i in order], np.int64), length, kmer,
        )
        found = pd.DataFrame({
            "c1": np.array([c1[r][i] for r, i in order], np.int64), "c2": np.array([c2[r][i] for r, i in order], np.int64),
            "lo": lo, "hi": hi,
        })
        return found[found["hi"] > 0]

    runs = contexts.select("h", "c1", "c2", "before", "context").mapInArrow(
        to_runs, "bucket long, c1 array<long>, c2 array<long>, shared array<int>, sizes array<int>, rest binary, "
        "lefts array<int>, left binary"
    )
    return runs.groupBy("bucket").applyInPandas(merge, "c1 long, c2 long, lo long, hi long")


def hashed_answers(contexts: DataFrame, length: int, kmer: int) -> DataFrame:
    """The same answers by counting the hashes of all windows, for any number of contexts."""
    reach = length - kmer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c1, c2, before, context in zip(*(batch.column(i).to_pylist() for i in range(5))):
                offsets = [d for d in range(min(before, reach) + 1) if before - d + length <= len(context)]
                names = [xxhash.xxh3_128_digest(context[before - d : before - d + length]) for d in offsets]
                if names:
                    both = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
                    k = len(offsets)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([h] * k), pa.array([c1] * k), pa.array([c2] * k), pa.array(offsets, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())],
                        names=["h", "c1", "c2", "d", "w1", "w2"],
                    )

    windows = store(
        contexts.select("h", "c1", "c2", "before", "context").mapInArrow(run, "h long, c1 long, c2 long, d long, w1 long, w2 long"), "windows"
    ).df
    # Only windows at one offset of one anchor hash are compared: contexts of neighbouring
    # anchors hold the same bytes of the same text.
    same, name = ["h", "d", "w1", "w2"], F.xxhash64("c1", "c2")
    twice = windows.groupBy(*same).agg(F.min(name).alias("x"), F.max(name).alias("y")).where("x <> y").select(*same)
    return (
        windows.join(twice, same).groupBy("c1", "c2")
        .agg(F.max("d").alias("lo"), (F.lit(length) - F.min("d")).alias("hi"))
    )


# -- spans of whole texts -----------------------------------------------------------------


def repeated_spans(documents: DataFrame, length: int = LENGTH, kmer: int = KMER, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """t1, t2, copies and ``spans`` (array of low, high byte) of every text that has any or is copied."""
    keyed = documents.select("doc_id", *text_key(), F.coalesce("text", F.lit("")).alias("text"))
    long = keyed.where(F.octet_length("text") >= length)
    marks = store(anchor_table(long.select("t1", "t2", "text"), length, kmer), "anchors").df
    place = F.xxhash64("t1", "t2", "pos")
    # Stored sides let Spark split a hot anchor hash over tasks while it joins.
    twice = store(
        marks.groupBy("h").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("h"), "twice"
    ).df
    found = marks.join(twice, "h").groupBy("t1", "t2").agg(F.collect_set(F.struct("pos", "h")).alias("found"))
    # One row stands for a text and all its copies.
    chosen = F.coalesce(F.xxhash64("doc_id"), F.lit(0)).alias("row")
    texts = long.select("t1", "t2", chosen).groupBy("t1", "t2").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"))
    texts = store(texts, "texts").df
    asked = found.join(texts.select("t1", "t2", "row"), ["t1", "t2"])
    rows = long.select("t1", "t2", chosen, "text").join(asked, ["t1", "t2", "row"]).select("t1", "t2", "text", "found")
    members = store(context_table(rows, length, kmer), "contexts").df

    kinds = store(
        members.groupBy("h", "c1", "c2").agg(
            F.min(place).alias("x"), F.max(place).alias("y"), F.first("before").alias("before"), F.first("after").alias("after")
        ).select("h", "c1", "c2", "before", "after", (F.col("x") != F.col("y")).alias("copied")), "kinds"
    ).df
    groups = store(
        kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("copied").alias("all_copied"))
        .where("n > 1 AND NOT all_copied").select("h", "n"), "groups"
    ).df
    distinct = members.where("context IS NOT NULL").join(groups, "h").dropDuplicates(["c1", "c2"])
    needed = groups.agg(F.sum(F.when(F.col("n") <= hot_contexts, F.col("n"))), F.max("n")).first()
    whole = kinds.where(F.col("copied") & (F.col("before") + F.col("after") >= length)).select(
        "c1", "c2", F.col("before").cast("long").alias("lo"), F.col("after").cast("long").alias("hi")
    )
    answers = whole
    buckets = max(1, -(-(needed[0] or 0) // BUCKET_CONTEXTS), documents.sparkSession.sparkContext.defaultParallelism)
    answers = answers.unionByName(merged_answers(distinct.where(F.col("n") <= hot_contexts), buckets, length, kmer))
    if (needed[1] or 0) > hot_contexts:
        answers = answers.unionByName(hashed_answers(distinct.where(F.col("n") > hot_contexts), length, kmer))
    answers = store(answers.groupBy("c1", "c2").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi")), "answers").df
    covers = members.select("t1", "t2", "pos", "c1", "c2").join(answers, ["c1", "c2"]).select(
        "t1", "t2", F.struct((F.col("pos") - F.col("lo")).alias("low"), (F.col("pos") + F.col("hi")).alias("high")).alias("span")
    )
    spans = covers.groupBy("t1", "t2").agg(F.collect_set("span").alias("spans"))
    return store(
        texts.where("copies > 1").select("t1", "t2", "copies").join(spans, ["t1", "t2"], "full"), "spans"
    ).df


def union_of(spans: Sequence[dict]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover."""
    out: list[list[int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def _cut_out(text: bytes, copies: int | None, spans: Sequence[dict] | None, length: int) -> tuple[bytes, list[tuple[int, int]]]:
    gone = [(0, len(text))] if copies and copies > 1 and len(text) >= length else union_of(spans or [])
    kept, at = [], 0
    for low, high in gone:
        kept.append(text[at:low])
        at = high
    kept.append(text[at:])
    return b"".join(kept), gone


def _with_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    keyed = documents.select(*documents.columns, *[c.alias(f"__{n}") for n, c in zip(("t1", "t2"), text_key())])
    named = spans.select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), F.col("copies").alias("__copies"), F.col("spans").alias("__spans"))
    return keyed.join(named, ["__t1", "__t2"], "left").drop("__t1", "__t2")


def removal(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    slim = documents.select("doc_id", "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    marked = _with_spans(slim, repeated_spans(slim, length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, copies, spans in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                text = (text or "").encode()
                kept, gone = _cut_out(text, copies, spans, length)
                out.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
            if out:
                n, removed, runs, digest = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return marked.select("doc_id", "text", "__copies", "__spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def remove_repeats(documents: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """The rows with the repeated bytes cut out of ``text`` (and ``n_chars`` counted anew, if there).

    A character that loses some of its bytes goes as a whole. A null text stays null; rows stay
    even if nothing is left of their text.
    """
    marked = _with_spans(documents, repeated_spans(documents.select("doc_id", "text"), length, kmer))
    at, copies_at, spans_at = (marked.columns.index(c) for c in ("text", "__copies", "__spans"))
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, copies, spans in zip(*(batch.column(i).to_pylist() for i in (at, copies_at, spans_at))):
                if text is not None and (copies or spans):
                    text = _cut_out(text.encode(), copies, spans, length)[0].decode(errors="ignore")
                texts.append(text)
            columns = dict(zip(names, batch.columns))
            columns["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    cleaned = marked.mapInArrow(run, documents.schema)
    if "n_chars" in names:
        kind = documents.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return cleaned
