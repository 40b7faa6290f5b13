"""Token ids of whole texts, by the tokenizers library, and a bit-packed file format for them.

A byte-level BPE tokenizer first splits a text at a fixed pattern and then merges inside each
piece. The split is done for a whole batch with numpy; every distinct piece is given to the
tokenizers library once per task and its ids are looked up afterwards. A text that holds the
string of an added token goes to the library whole.

File format (one row of a Parquet table per block, so that writing is atomic, retried tasks
leave no second copy, and any store that Spark reads will do): ids in ``width`` bits each, the
minimum for the vocabulary, little-endian and without gaps, and the offsets of the documents
in the block. A block ends with a document, so each can be read on its own.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from columnwright.llm.ranges import id_ranges
from columnwright.llm.words import mix, powers, spans, text_column
from columnwright.storage import fresh_path

# Texts of a batch that are split at once, in characters; one longer text goes alone.
CHUNK_CHARS = 1_000_000
# Pieces a task remembers before it starts anew.
REMEMBERED = 2_000_000
BLOCK_IDS = 65_536
# Text that one range of documents holds, about, in bytes.
RANGE_BYTES = 8_000_000

_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
LETTER, NUMBER, WHITE, OTHER = 0, 1, 2, 3


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point in the split pattern."""
    table = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            table[point] = LETTER
        elif kind == "N":
            table[point] = NUMBER
    white = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[white] = WHITE
    return table


def split_points(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First positions of the pieces of some texts laid end to end (``bounds``: their offsets).

    The pattern is: a contraction, or an optional space with a run of letters, numbers or
    other characters, or white space, of which the last character before a run is left over.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    begins = np.zeros(n + 1, bool)
    begins[bounds] = True
    first = begins[:n]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run & (kind != WHITE)
    # A space right before a run of another class belongs to that run.
    at = np.flatnonzero(start & ~first)
    spaced = points[at - 1] == 0x20
    start[at[spaced]] = False
    start[at[spaced] - 1] = True
    # White space: a run starts a piece; its last character is split off before a run.
    start |= run & (kind == WHITE)
    loose = at[~spaced & (kind[at - 1] == WHITE)]
    start[loose - 1] = True
    # Contractions: a lone apostrophe that starts a piece, and the letters after it.
    quote = np.flatnonzero(start & (points == 0x27))
    quote = quote[quote + 1 < n]
    quote = quote[~begins[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        one = points[quote + 1]
        two = np.where((quote + 2 < n) & ~begins[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            double |= (one == ord(a)) & (two == ord(b))
        for found, length in ((single, 2), (double, 3)):
            q = quote[found]
            start[q + 1] = False
            after = q[q + length < n] + length
            start[after[~first[after] & (kind[after] == LETTER)]] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of batches of texts; remembers the ids of pieces it has met."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary = self.tokenizer.get_vocab_size()
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.where = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(size.sum()))
        where = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, flat])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.where = np.insert(self.where, at, where)
        self.size = np.insert(self.size, at, size)

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = split_points(points, bounds)
        ends = np.append(starts[1:], len(points)) if len(starts) else starts
        terms = (points.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(points))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        keys = mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(points) + 1)[starts]
                   + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.keys) + len(new) > REMEMBERED:
                self._forget()
                new = np.arange(len(distinct))
            a, b = starts[first[new]].tolist(), ends[first[new]].tolist()
            self._learn(distinct[new], [joined[x:y] for x, y in zip(a, b)])
            at = np.searchsorted(self.keys, distinct)
        where, size = self.where[at][back], self.size[at][back].astype(np.int64)
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.ids[np.arange(total) + np.repeat(where - (stop - size), size)]
        per_text = np.searchsorted(starts, bounds)
        done = np.concatenate([[0], stop])
        return ids, done[per_text]

    def encode(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, one after the last, their ids, offsets of each text in the ids)."""
        sizes = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        for first, last in spans(sizes, CHUNK_CHARS):
            own = texts[first:last]
            odd = [i for i, t in enumerate(own) if any(a in t for a in self.added)]
            ids, offsets = self._chunk(["" if i in odd else t for i, t in enumerate(own)] if odd else own)
            if odd:
                parts = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
                for i in odd:
                    parts[i] = np.array(self.tokenizer.encode(own[i], add_special_tokens=False).ids, np.uint32)
                ids = np.concatenate(parts)
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            yield first, last, ids, offsets


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text, and the new offsets."""
    out = np.insert(ids, offsets[1:], end_id)
    return out, offsets + np.arange(len(offsets))


def tokenised(documents: DataFrame, end_id: int, path: str, keep: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, ``keep`` columns, and ``ids`` (little-endian unsigned 32-bit, with the end id) of every row."""
    chosen = documents.select("doc_id", "text", *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "text")
    names = [f.name for f in chosen.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            texts = text_column(batch.column(1)).to_pylist()
            others = [batch.column(i) for i in range(batch.num_columns) if i != 1]
            for first, last, ids, offsets in tool.encode(texts):
                ids, offsets = with_end(ids, offsets, end_id)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(first, last - first) for c in others), binary_slices(ids, offsets)],
                    names=[*names, "ids"],
                )

    return chosen.mapInArrow(run, f"{schema}, ids binary")


def binary_slices(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The ranges of a 32-bit array as a binary column, without copying each."""
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1,
        [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, np.uint32))],
    )


# -- bit packing --------------------------------------------------------------------------


def id_width(vocabulary: int) -> int:
    """The minimum number of bits for ids below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``width`` bits per id, lowest bit first, no gaps."""
    ids = np.ascontiguousarray(ids, np.uint32)
    if len(ids) and width < 32 and int(ids.max()) >> width:
        raise ValueError(f"an id does not fit in {width} bits")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width].ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from place ``first``: only the bytes that hold them are looked at."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", count, first * width // 8).astype(np.uint32)
    low, high = first * width // 8, -(-(first + count) * width // 8)
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, high - low, low), bitorder="little")
    skip = first * width - low * 8
    bits = bits[skip : skip + count * width].reshape(count, width)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


BLOCK_SCHEMA = ("shard int, block int, before long, n_ids long, width int, doc_ids array<long>, "
                "starts array<long>, payload binary")


def write_blocks(documents: DataFrame, path: str, tokenizer: str, end_id: int,
                 block_ids: int = BLOCK_IDS, range_bytes: int = RANGE_BYTES) -> None:
    """Encode every text, append ``end_id`` and write the ids in ascending ``doc_id`` order.

    A shard holds a range of ids. Packed ids, not texts, are shuffled to their shard; a task
    writes block after block while it reads its rows in order.
    """
    width = id_width(encoder(tokenizer).vocabulary)
    weight = F.octet_length(F.coalesce("text", F.lit("")))
    ranges = id_ranges(documents.select("doc_id", "text"), weight, range_bytes)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        for batch in batches:
            texts = text_column(batch.column(1)).to_pylist()
            for first, last, ids, offsets in tool.encode(texts):
                ids, offsets = with_end(ids, offsets, end_id)
                parts = [pack(ids[a:b], width) for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), batch.column(2).slice(first, last - first),
                     pa.array(np.diff(offsets)), pa.array(parts, pa.binary())],
                    names=["doc_id", "shard", "n", "packed"],
                )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before, ids, parts, starts, size = None, 0, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            payload = pack(np.concatenate(parts), width)
            values = [[shard], [block], [before], [size], [width], [ids], [starts], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()),
                     pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds)],
                names=["shard", "block", "before", "n_ids", "width", "doc_ids", "starts", "payload"],
            )

        for batch in batches:
            for doc, own, n, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if parts and (own != shard or size >= block_ids):
                    yield flush()
                    block, before = block + 1, before + size
                    ids, parts, starts, size = [], [], [], 0
                if own != shard:
                    shard, block, before = own, 0, 0
                ids.append(doc)
                starts.append(size)
                parts.append(unpack(packed, width, 0, n))
                size += n
        if parts:
            yield flush()

    marked = ranges.mark(documents.select("doc_id", "text"), "shard").select("doc_id", "text", "shard")
    packed = marked.mapInArrow(shrink, "doc_id long, shard int, n long, packed binary")
    (
        packed.repartition(ranges.count, "shard")
        .sortWithinPartitions("shard", "doc_id", "n", "packed")
        .mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(path)
    )


def read_documents(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (32-bit) from the files.

    With ``doc_ids`` only the blocks that may hold them are unpacked, and of those only the
    ids of the wanted documents.
    """
    table = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    sizes = table.groupBy("shard").agg(F.sum("n_ids").alias("__n"))  # a row per shard
    rows = sorted(sizes.collect())
    base, so_far = {}, 0
    for shard, n in rows:
        base[shard] = so_far
        so_far += n
    wanted = None if doc_ids is None else sorted(set(doc_ids))
    if wanted is not None:
        table = table.where(F.exists("doc_ids", lambda d: d.isin(wanted) if wanted else F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, _, before, n_ids, width, ids, starts, payload = (c[i].as_py() for c in batch.columns)
                starts = np.array([*starts, n_ids], np.int64)
                take = [k for k, d in enumerate(ids) if wanted is None or d in wanted]
                if wanted is None:
                    values = unpack(payload, width, 0, n_ids)
                    column = binary_slices(values, starts)
                else:
                    column = pa.array(
                        [unpack(payload, width, starts[k], starts[k + 1] - starts[k]).tobytes() for k in take], pa.binary()
                    )
                at = np.array(take, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[k] for k in take], pa.int64()), pa.array(base[shard] + before + starts[at]),
                     pa.array(starts[at + 1] - starts[at]), column],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_table(documents: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the ids of all documents, read them back: doc_id, start, n_tokens, ids_crc32.

    Null texts are empty (the end id alone); null ids come first; rows that repeat a
    ``doc_id`` follow each other, shorter ones first, then by their ids; an empty table
    writes no block.
    """
    spark = documents.sparkSession
    path = fresh_path(spark, "tokens")
    write_blocks(documents, path, tokenizer or tokenizer_path(), end_id)
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
