"""Words, lines and rolling hashes of Arrow text batches, without a Python loop over words.

Texts are UTF-8 bytes. A word is a run of bytes other than space and 0x09-0x0D; those never
occur inside a longer UTF-8 sequence, so bytes and characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes that are worked on at once; one longer text makes a chunk of its own.
CHUNK_BYTES = 2_000_000

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# All ASCII but letters and digits; bytes of longer sequences are parts of words.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next batch."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits (the finaliser of SplitMix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_column(column) -> pa.Array:
    """One string array with 32-bit offsets; a null text is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.string()).fill_null("")


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets) of an Arrow string column."""
    column = text_column(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive (first text, one after the last) with at most ``limit`` bytes, or one text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Chunk:
    """Some texts of a batch: their bytes, words and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> None:
        self.data, self.offsets, self.texts = data, offsets, len(offsets) - 1
        space = separators[data]
        self.wordy = ~space
        n = len(data)
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = True, space[:-1]
            after[-1], after[:-1] = True, space[1:]
            edges = offsets[offsets < n]
            before[edges] = True
            after[offsets[(offsets > 0)] - 1] = True
        self.starts = np.flatnonzero(self.wordy & before)
        self.ends = np.flatnonzero(self.wordy & after) + 1
        # Words up to each text's start.
        self.word_at = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.word_at)
        self._sums: np.ndarray | None = None

    def text_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), self.n_words)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range: equal bytes, equal hash."""
        if self._sums is None:
            terms = (self.data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(self.data))
            self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        raw = (self._sums[ends] - self._sums[starts]) * powers(INVERSE, len(self.data) + 1)[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def count_by_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text have the flag."""
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[self.offsets])


def chunks(
    column, limit: int = CHUNK_BYTES, separators: np.ndarray = SPACE, lower: bool = False
) -> Iterator[tuple[int, int, Chunk]]:
    """(first text, one after the last, their chunk) over a string column, in order.

    ``separators`` marks the bytes between words; ``lower`` turns A-Z into a-z first.
    """
    data, offsets = text_bytes(column)
    for first, last in spans(offsets, limit):
        own = offsets[first : last + 1]
        part = data[own[0] : own[-1]]
        yield first, last, Chunk(LOWER[part] if lower else part, own - own[0], separators)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur twice or more."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        out[order[1:]] |= same
        out[order[:-1]] |= same
    return out


def repeats_of_earlier(keys: np.ndarray) -> np.ndarray:
    """Which of the keys already occur before their place."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return out
