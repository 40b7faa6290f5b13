"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate.

Every line of a text has a small vector of features. A linear-chain CRF with the two states
boilerplate (0) and content (1) is fitted to lines of labelled documents; Viterbi decoding
gives the best state sequence of a whole text, and the share of its words on content lines
decides whether the text is retained.

Defined results: a null text is the empty text (no words, base failed, not kept); the row of a
null or repeated ``doc_id`` is judged like any other; an empty table gives an empty table;
columns other than the text are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from columnwright.llm.words import Chunk, chunks, mix, repeated, repeats_of_earlier

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
CONTENT_SHARE = 0.5
# Labelled documents that the CRF is fitted to, at most: the first ones in hash order.
SAMPLE_DOCS = 4_000
STEPS = 150
SYMBOLS = b"#*$%&|<>"
FEATURES = ("bias", "few_words", "many_words", "symbols", "exclaims", "duplicate", "repeats",
            "upper", "digits", "ends_sentence", "long_words", "one_word_runs")

_is = {name: np.zeros(256, bool) for name in ("symbol", "upper", "digit", "stop", "exclaim", "lower")}
_is["symbol"][list(SYMBOLS)] = True
_is["upper"][65:91] = True
_is["lower"][97:123] = True
_is["digit"][48:58] = True
_is["stop"][list(b".!?:;\"')")] = True
_is["exclaim"][list(b"!")] = True


@dataclass(frozen=True)
class LineModel:
    """Weights: ``emit`` per state and feature, ``move`` from state to state, ``begin`` per state."""

    emit: np.ndarray
    move: np.ndarray
    begin: np.ndarray


def plain_model() -> LineModel:
    """What is used without labelled documents: symbols, repeats and shouting mark boilerplate."""
    emit = np.zeros((2, len(FEATURES)))
    for name, weight in (("symbols", 4.0), ("exclaims", 2.0), ("duplicate", 2.0), ("repeats", 4.0),
                         ("upper", 3.0), ("bias", -1.5)):
        emit[0, FEATURES.index(name)] = weight
    return LineModel(emit, np.array([[1.0, 0.0], [0.0, 1.0]]), np.zeros(2))


@dataclass(frozen=True)
class Lines:
    """The lines with a word, in order: their text, words and features; and counts per text."""

    text: np.ndarray
    words: np.ndarray
    features: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def lines_of(chunk: Chunk) -> Lines:
    """Lines are split at ``\\n``; those without a word carry no state."""
    data, offsets, n_texts = chunk.data, chunk.offsets, chunk.texts
    lead = (data & 0xC0) != 0x80
    word_chars = chunk.count_by_text(chunk.wordy & lead)
    n_symbols = chunk.count_by_text(_is["symbol"][data])

    of_word = chunk.text_of_words()
    covered = np.zeros(len(of_word), bool)
    hashes = chunk.word_hashes()
    if len(hashes) > 2:
        same_text = of_word[2:] == of_word[:-2]
        key = mix(hashes[:-2]) * np.uint64(3) + mix(hashes[1:-1] + np.uint64(1)) * np.uint64(5) + hashes[2:]
        key = mix(key + of_word[2:].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        at = np.flatnonzero(same_text)
        twice = at[repeated(key[at])]
        for shift in range(3):
            covered[twice + shift] = True
    n_repeat = np.bincount(of_word[covered], minlength=n_texts)

    newline = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], newline + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))[: len(starts)]
    # A line ends before its \n.
    if len(starts):
        ends = np.where((ends > starts) & (data[ends - 1] == 10), ends - 1, ends)
    first_word = np.searchsorted(chunk.starts, starts)
    words = np.searchsorted(chunk.starts, ends) - first_word
    keep = words > 0
    starts, ends, words, first_word = starts[keep], ends[keep], words[keep], first_word[keep]
    text = np.searchsorted(offsets, starts, "right") - 1
    key = mix(chunk.hashes(starts, ends) + text.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    duplicate = repeats_of_earlier(key)

    def within(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[ends] - sums[starts]

    chars = np.maximum(within(chunk.wordy & lead), 1)
    sums = np.concatenate([[0], np.cumsum(covered)])
    repeats = (sums[first_word + words] - sums[first_word]) / np.maximum(words, 1)
    runs = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        runs[1:] = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
    sums = np.concatenate([[0], np.cumsum(runs)])
    same_runs = (sums[first_word + words] - sums[first_word]) / np.maximum(words, 1)
    upper, lower = within(_is["upper"][data]), within(_is["lower"][data])
    last = chunk.ends[first_word + words - 1] - 1 if len(starts) else starts
    features = np.stack([
        np.ones(len(starts)),
        words <= 3,
        words >= 15,
        np.minimum(within(_is["symbol"][data]) / words, 1.0),
        np.minimum(within(_is["exclaim"][data]) / words, 1.0),
        duplicate,
        repeats,
        upper > lower,
        np.minimum(within(_is["digit"][data]) / chars, 1.0),
        _is["stop"][data[last]] if len(starts) else starts,
        chars / words > 12,
        same_runs,
    ], axis=1).astype(np.float64)
    return Lines(text, words, features, word_chars, n_symbols,
                 np.bincount(text[duplicate], minlength=n_texts), n_repeat)


def _by_length(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first line, number of lines) of the sequences, longest first."""
    firsts = np.flatnonzero(np.diff(text, prepend=-1))
    lengths = np.diff(np.append(firsts, len(text)))
    order = np.argsort(-lengths, kind="stable")
    return firsts[order], lengths[order]


def viterbi(model: LineModel, text: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Best state of every line; all sequences advance together, ties go to content."""
    score = features @ model.emit.T
    back = np.zeros((len(text), 2), np.int8)
    firsts, lengths = _by_length(text)
    states = np.zeros(len(text), np.int8)
    if not len(firsts):
        return states
    best = model.begin + score[firsts]
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
    ends = np.empty((len(firsts), 2))
    for t in range(1, lengths[0]):
        n = alive[t]
        ends[n : alive[t - 1]] = best[n:]
        best = best[:n]
        came = best[:, :, None] + model.move[None]
        choice = (came[:, 1] >= came[:, 0]).astype(np.int8)
        at = firsts[:n] + t
        back[at] = choice
        best = np.where(choice == 1, came[:, 1], came[:, 0]) + score[at]
    ends[: len(best)] = best
    now = (ends[:, 1] >= ends[:, 0]).astype(np.int8)
    for t in range(lengths[0] - 1, -1, -1):
        n = alive[t]
        at = firsts[:n] + t
        states[at] = now[:n]
        now[:n] = back[at, now[:n]]
    return states


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def fit(text: np.ndarray, features: np.ndarray, states: np.ndarray, steps: int = STEPS,
        penalty: float = 1e-3) -> LineModel:
    """Maximum likelihood by Adam on the exact forward-backward gradient, with an L2 penalty."""
    if not len(text) or len(np.unique(states)) < 2:
        return plain_model()
    firsts, lengths = _by_length(text)
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
    truth = np.eye(2)[states]
    same = text[1:] == text[:-1]
    moved = np.zeros((2, 2))
    np.add.at(moved, (states[:-1][same], states[1:][same]), 1)
    begun = truth[firsts].sum(0)
    n, k = len(text), features.shape[1]
    theta = np.zeros(2 * k + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        emit, move, begin = theta[: 2 * k].reshape(2, k), theta[2 * k : 2 * k + 4].reshape(2, 2), theta[-2:]
        score = features @ emit.T
        forward = np.empty((n, 2))
        forward[firsts] = begin + score[firsts]
        for t in range(1, lengths[0]):
            at = firsts[: alive[t]] + t
            forward[at] = _logsum(forward[at - 1][:, :, None] + move[None], 1) + score[at]
        backward = np.zeros((n, 2))
        pairs = np.zeros((2, 2))
        total = _logsum(forward[firsts + lengths - 1], 1)
        for t in range(lengths[0] - 1, 0, -1):
            at = firsts[: alive[t]] + t
            after = score[at] + backward[at]
            joint = forward[at - 1][:, :, None] + move[None] + after[:, None, :]
            pairs += np.exp(joint - total[: alive[t], None, None]).sum(0)
            backward[at - 1] = _logsum(move[None] + after[:, None, :], 2)
        of = np.repeat(total[np.argsort(firsts)], lengths[np.argsort(firsts)])
        node = np.exp(forward + backward - of[:, None])
        gradient = np.concatenate([
            ((truth - node).T @ features).ravel(), (moved - pairs).ravel(), begun - node[firsts].sum(0),
        ]) / n - penalty * theta
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return LineModel(theta[: 2 * k].reshape(2, k), theta[2 * k : 2 * k + 4].reshape(2, 2), theta[-2:])


def train(documents: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LineModel:
    """Fit the CRF to at most ``sample_docs`` labelled documents, the first in hash order.

    The lines of a document labelled good count as content, those of a bad one as boilerplate.
    Both classes have half of the sample, so that rare bad documents are seen.
    """
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("__good")).where(
        "doc_id IS NOT NULL AND __good IN (0, 1)"
    )
    at = F.xxhash64(F.col("doc_id").cast("string"))
    picked = None
    for good in (0, 1):
        half = rows.where(F.col("__good") == good).orderBy(at, "doc_id").limit(max(1, sample_docs // 2))
        picked = half if picked is None else picked.union(half)
    sample = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "__good")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = batch.column(1).to_pylist()
            for first, last, chunk in chunks(batch.column(0)):
                found = lines_of(chunk)
                for i in range(first, last):
                    own = found.features[found.text == i - first]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([good[i]], pa.int32()), pa.array([own.astype(np.float32).tobytes()], pa.binary())],
                        names=["good", "features"],
                    )

    taken = sorted(
        ((r["good"], bytes(r["features"])) for r in sample.mapInArrow(lines, "good int, features binary").collect()),
    )
    blocks = [(g, np.frombuffer(b, np.float32).reshape(-1, len(FEATURES)).astype(np.float64)) for g, b in taken if b]
    if not blocks:
        return plain_model()
    text = np.repeat(np.arange(len(blocks)), [len(b) for _, b in blocks])
    states = np.repeat(np.array([g for g, _ in blocks], np.int64), [len(b) for _, b in blocks])
    return fit(text, np.concatenate([b for _, b in blocks]), states)


def judge(chunk: Chunk, model: LineModel, share: float = CONTENT_SHARE) -> dict[str, np.ndarray]:
    """The counts and verdicts of the texts of a chunk."""
    lines = lines_of(chunk)
    n = chunk.n_words
    failed = (n < MIN_WORDS) | (100 * lines.n_repeat_words > MAX_REPEAT_PERCENT * n)
    states = viterbi(model, lines.text, lines.features)
    content = np.bincount(lines.text, weights=lines.words * states, minlength=chunk.texts)
    content_share = content / np.maximum(n, 1)
    return {
        "n_words": n, "word_chars": lines.word_chars, "n_symbols": lines.n_symbols,
        "n_dup_lines": lines.n_dup_lines, "n_repeat_words": lines.n_repeat_words,
        "base_failed": failed, "kept": ~failed & (content_share >= share), "content_share": content_share,
    }


JUDGED = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, content_share double")


def score_documents(documents: DataFrame, model: LineModel, share: float = CONTENT_SHARE) -> DataFrame:
    """doc_id, the counts, ``base_failed``, ``kept`` and the content share of every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    types = {"base_failed": pa.bool_(), "kept": pa.bool_(), "content_share": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, chunk in chunks(batch.column(1)):
                found = judge(chunk, model, share)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first),
                     *(pa.array(v, types.get(k, pa.int64())) for k, v in found.items())],
                    names=["doc_id", *found],
                )

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {JUDGED}")


def keep_documents(documents: DataFrame, model: LineModel, share: float = CONTENT_SHARE) -> DataFrame:
    """The rows whose text is kept, with all their columns."""
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [judge(chunk, model, share)["kept"] for _, _, chunk in chunks(batch.column(at))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return documents.mapInArrow(run, documents.schema)
