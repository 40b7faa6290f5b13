"""Languages of texts and of the spans inside them.

A word is a run of letters. Its script (the block of Unicode its letters are from) leaves those
languages as candidates whose training texts use that script. A candidate scores a word by the
log probabilities of the word's hashed character n-grams (one to ``GRAM`` letters, with the
word's ends marked), counted over all training rows. Viterbi decoding over the words of a text,
with one penalty for every change of language, labels spans; the language with most letters in
its spans is the text's.

Viterbi runs over all texts of a chunk at once: texts are cut into segments of ``STEPS`` words,
the best score from each language before a segment to each language at its end is a matrix of
maxima and sums, and these matrices are chained. So a very long text costs as many steps as a
short one, and the path is the exact best one.

Defined results: a null text, a text without letters, and every text if no language was learned
is ``und`` with score 0 and no spans; score is the share of the text's letters in spans of its
language; equal shares go to the language first in alphabetical order; words of a script that no
language uses speak for none and follow their neighbours; a null ``doc_id`` counts as empty text
and is not held out; repeated rows get equal results; rows with a null or empty ``lang`` are not
learned from; a very long text makes a chunk of its own; an empty table gives an empty table;
other columns are ignored. The model has one row of ``BUCKETS`` numbers per language; what tasks
send is one count per language and bucket.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from columnwright.llm.words import mix, spans, text_bytes

BUCKETS = 1 << 16
GRAM = 4
FOLDS, HELD_OUT = 4, 2
# Price of a change of language, in natural logarithms.
PENALTY = 12.0
STEPS = 32
# A language uses a script from this share of its training letters on.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
CHUNK_BYTES = 1_000_000
# Words whose n-grams are worked out at once.
PART_WORDS = 100_000
POINTS = 0x110000

# First code points of the ranges that scripts are told apart by, to the next one's.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"),
    (0x0B80, "Tamil"), (0x0C00, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Other"),
    (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2100, "Latin"), (0x2C00, "Other"),
    (0x2C60, "Latin"), (0x2C80, "Other"), (0x2DE0, "Cyrillic"), (0x2E00, "Other"), (0x2E80, "Han"),
    (0x3040, "Kana"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3400, "Han"), (0xA000, "Other"),
    (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"),
    (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF65, "Kana"),
    (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x32000, "Other"),
)
NAMES = sorted({name for _, name in SCRIPTS})
FIRST = np.array([at for at, _ in SCRIPTS])
KIND = np.array([NAMES.index(name) for _, name in SCRIPTS])


@cache
def _letters() -> np.ndarray:
    """Which code points are letters (and the marks that belong to them)."""
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(POINTS)])


@cache
def _marks() -> np.ndarray:
    return np.array([unicodedata.category(chr(i))[0] == "M" for i in range(POINTS)])


@cache
def _lower() -> np.ndarray:
    out = np.arange(POINTS, dtype=np.uint32)
    for i in np.flatnonzero(_letters()).tolist():
        small = chr(i).lower()
        if len(small) == 1:
            out[i] = ord(small)
    return out


class Words:
    """The words of some texts: where they are, their script and the buckets of their n-grams."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.texts = len(offsets) - 1
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        # Code points before each text: bytes that do not go on a sequence start one.
        starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.at = starts[offsets]
        letter = _letters()[points]
        if len(points):
            # A mark after a letter is part of its word.
            part = letter | (_marks()[points] & np.append(False, letter[:-1]))
        else:
            part = letter
        before, after = np.ones(len(points), bool), np.ones(len(points), bool)
        before[1:], after[:-1] = ~part[:-1], ~part[1:]
        inner = self.at[(self.at > 0) & (self.at < len(points))]
        before[inner] = True
        after[inner - 1] = True
        self.starts = np.flatnonzero(part & before)
        self.ends = np.flatnonzero(part & after) + 1
        self.word_at = np.searchsorted(self.starts, self.at)
        self.sizes = self.ends - self.starts
        self.script = KIND[np.searchsorted(FIRST, points[self.starts], "right") - 1]
        self.letters = np.bincount(np.searchsorted(self.at, np.flatnonzero(letter), "right") - 1, minlength=self.texts)[: self.texts]
        self.points = points

    def text_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), np.diff(self.word_at))

    def parts(self) -> Iterator[tuple[int, int]]:
        """(first word, one after the last) of parts of bounded size, so that long texts fit."""
        for first in range(0, len(self.starts), PART_WORDS):
            yield first, min(first + PART_WORDS, len(self.starts))

    def grams(self, begin: int, end: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(word less ``begin``, bucket) of every n-gram; words stand with a space before and after them."""
        n, sizes, starts = end - begin, self.sizes[begin:end], self.starts[begin:end]
        width = sizes + 2
        first = np.concatenate([[0], np.cumsum(width)])
        owner = np.repeat(np.arange(n), width)
        row = np.full(first[-1], 0x20, np.uint64)
        within = np.arange(first[-1]) - first[owner]
        inside = (within > 0) & (within <= sizes[owner])
        row[inside] = _lower()[self.points[starts[owner[inside]] + within[inside] - 1]]
        words, found = [], []
        rolling = np.zeros(len(row), np.uint64)
        for size in range(1, GRAM + 1):
            fits = len(row) - size + 1
            if fits <= 0:
                break
            rolling = rolling[:fits] * np.uint64(0x110001) + row[size - 1 :] + np.uint64(1)
            whole = owner[:fits] == owner[size - 1 :]
            if size == 1:
                whole = inside
            words.append(owner[:fits][whole])
            found.append(mix(rolling[whole] + np.uint64(size)) % np.uint64(buckets))
        return np.concatenate(words) if words else np.zeros(0, np.int64), (
            np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
        )


def word_chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first text, one after the last, their words) over a string column, in order."""
    data, offsets = text_bytes(column)
    for first, last in spans(offsets, limit):
        own = offsets[first : last + 1]
        yield first, last, Words(data[own[0] : own[-1]], own - own[0])


@dataclass(frozen=True)
class Model:
    """Log probability of each bucket per language, and the scripts a language uses."""

    names: list[str]
    weights: np.ndarray  # (bucket, language)
    uses: np.ndarray  # (script, language)

    def emissions(self, words: Words) -> np.ndarray:
        """(word, language): log likelihoods less the word's mean over its candidates."""
        n, width = len(words.starts), len(self.names)
        out = np.zeros((n, width))
        for first, last in words.parts():
            owner, bucket = words.grams(first, last, len(self.weights))
            for i in range(width):
                out[first:last, i] = np.bincount(owner, weights=self.weights[bucket, i], minlength=last - first)
        allowed = self.uses[words.script]
        some = allowed.any(1)
        mean = np.where(some, (out * allowed).sum(1) / np.maximum(allowed.sum(1), 1), 0.0)
        out = np.where(allowed, out - mean[:, None], -np.inf)
        out[~some] = 0.0
        # A language that does not use the script can only win by force of its neighbours.
        return np.maximum(out, np.where(some, out.min(1, where=allowed, initial=0.0), 0.0)[:, None] - PENALTY)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(FOLDS) == F.lit(HELD_OUT)


def train(documents: DataFrame, buckets: int = BUCKETS) -> Model:
    """A model from all rows that are not held out and have a language.

    Tasks add up their own rows, so each sends at most one count per language and bucket.
    """
    known = documents.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for first, last, words in word_chunks(batch.column(1)):
                lang_of_word = langs[first:last][words.text_of_words()]
                for begin, end in words.parts():
                    owner, bucket = words.grams(begin, end, buckets)
                    script, sizes = words.script[begin:end], words.sizes[begin:end]
                    for lang in set(lang_of_word[begin:end]):
                        mine = lang_of_word[begin:end] == lang
                        counts = own.setdefault(lang, np.zeros(buckets + len(NAMES), np.int64))
                        counts[:buckets] += np.bincount(bucket[mine[owner]], minlength=buckets)
                        counts[buckets:] += np.bincount(script[mine], weights=sizes[mine], minlength=len(NAMES)).astype(np.int64)
        for lang, counts in own.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "at", "n"]
            )

    rows = known.select(F.col("lang").cast("string"), "text").mapInArrow(run, "lang string, at long, n long")
    found = rows.groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found["lang"].to_pylist()))
    counts = np.zeros((buckets + len(NAMES), len(names)), np.int64)
    place = {x: i for i, x in enumerate(names)}
    column = np.array([place[x] for x in found["lang"].to_pylist()], np.int64)
    counts[np.asarray(found["at"]), column] = np.asarray(found["n"])
    grams, scripts = counts[:buckets], counts[buckets:]
    weights = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * buckets))
    return Model(names, weights, scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1))


def viterbi(scores: np.ndarray, word_at: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of every word; ``word_at`` are the first words of the texts, and their end.

    Among equally good paths one is picked by the order of the languages.
    """
    n, width = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    counts = np.diff(word_at)
    segments = -(-counts // STEPS)
    first = np.concatenate([[0], np.cumsum(segments)])
    text = np.repeat(np.arange(len(counts)), segments)
    number = np.arange(first[-1]) - first[text]
    # Words beyond a text's end score nothing and change nothing.
    owner = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(n) - word_at[owner]
    padded = np.zeros((first[-1], STEPS, width))
    padded[first[owner] + within // STEPS, within % STEPS] = scores
    # From every language before a segment to every language at its end.
    way = np.where(np.eye(width, dtype=bool), 0.0, -np.inf)[None].repeat(first[-1], 0)
    for step in range(STEPS):
        way = np.maximum(way, way.max(2, keepdims=True) - penalty) + padded[:, step, None, :]
    # Chain the segments of each text; those of all texts at a time.
    best = np.zeros((len(counts), width))
    back = np.zeros((first[-1], width), np.int64)
    by_number = np.argsort(number, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(number))])
    for i in range(len(bounds) - 1):
        now = by_number[bounds[i] : bounds[i + 1]]
        total = best[text[now]][:, :, None] + way[now]
        back[now] = total.argmax(1)
        best[text[now]] = total.max(1)
    entry, final = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
    at = best.argmax(1)
    for i in range(len(bounds) - 2, -1, -1):
        now = by_number[bounds[i] : bounds[i + 1]]
        final[now] = at[text[now]]
        entry[now] = back[now, final[now]]
        at[text[now]] = entry[now]
    # Inside the segments, both ends are known now.
    value = np.full((first[-1], width), -np.inf)
    value[np.arange(first[-1]), entry] = 0.0
    came = np.zeros((STEPS, first[-1], width), np.int8 if width < 128 else np.int32)
    for step in range(STEPS):
        top = value.argmax(1)
        changed = value.max(1)[:, None] - penalty > value
        came[step] = np.where(changed, top[:, None], np.arange(width))
        value = np.maximum(value, value.max(1, keepdims=True) - penalty) + padded[:, step]
    label = np.zeros((first[-1], STEPS), np.int64)
    state = final
    for step in range(STEPS - 1, -1, -1):
        label[:, step] = state
        state = came[step][np.arange(first[-1]), state]
    return label[first[owner] + within // STEPS, within % STEPS]


def label_texts(words: Words, model: Model) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
    """(number of the language or -1, score, spans) of every text."""
    if not model.names or not len(words.starts):
        return np.full(words.texts, -1), np.zeros(words.texts), [[] for _ in range(words.texts)]
    label = viterbi(model.emissions(words), words.word_at)
    text = words.text_of_words()
    share = np.bincount(text * len(model.names) + label, weights=words.sizes, minlength=words.texts * len(model.names))
    share = share.reshape(words.texts, len(model.names))
    total = share.sum(1)
    lang = np.where(total > 0, share.argmax(1), -1)
    score = share.max(1) / np.maximum(total, 1)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (label[1:] != label[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(text)) - 1
    out: list[list[dict]] = [[] for _ in range(words.texts)]
    for t, a, z, x in zip(text[begin].tolist(), words.starts[begin].tolist(), words.ends[end].tolist(), label[begin].tolist()):
        out[t].append({"start": a - int(words.at[t]), "end": z - int(words.at[t]), "lang": model.names[x]})
    return lang, score, out


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ``spans`` (start, end in code points; lang) of every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.names, UNKNOWN], object)
        for batch in batches:
            for first, last, words in word_chunks(batch.column(2)):
                lang, score, spans_ = label_texts(words, own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first),
                     pa.array(names[lang].tolist(), pa.string()), pa.array(score), pa.array(spans_, span)],
                    names=["doc_id", "held_out", "lang_pred", "score", "spans"],
                )

    return documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"
    )
