"""Prompt experiments: which rows to look at, what is not yet predicted, who scores best."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from columnwright.operators import prompts as ops
from columnwright.operators.prediction_cache import PredictionCache
from columnwright.operators.splits import split_random, subsample
from columnwright.storage import store

CACHE = "prompt string, x string, y string, score double, sequence string"
Predict = Callable[[DataFrame], DataFrame]


def empty_cache(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], CACHE)


def evaluate(
    task: DataFrame,
    keys: Sequence[str],
    prompts: Sequence[str],
    predict: Predict,
    cache: DataFrame | PredictionCache | None = None,
    strategy: str = "full",
    n: int = 30,
    block: int = 0,
    seed: int = 42,
    match: Callable[[Column, Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame | PredictionCache]:
    """Score prompts on a task table (keys, x, y): (pairs with scores, extended cache).

    ``predict`` takes (prompt, x, y) pairs and adds ``prediction`` and ``sequence``; only
    pairs that the cache lacks reach it. A ``PredictionCache`` is added to in place.
    """
    rows = subsample(task, keys, strategy, n, block, seed)
    pairs = ops.pairs_cross(rows, prompts)
    if isinstance(cache, PredictionCache):
        missing = cache.missing(pairs)
        asked = missing.where(F.lit(False)) if strategy == "evaluated" else missing
        cache.add(ops.score_predictions(predict(asked), match))
        return cache.collect(pairs), cache
    known = empty_cache(task) if cache is None else cache
    asked = ops.pairs_to_predict(pairs, known, strategy).select(*ops.PAIR).distinct()
    # Predictions are dear: they are written once. None of their pairs is in the cache.
    new = store(ops.score_predictions(predict(asked), match), "predictions").df
    extended = known.unionByName(new)
    return ops.cache_collect(pairs, extended), extended


@dataclass(frozen=True)
class ExemplarRace:
    """``best``: prompt, seed, text, score; ``rungs``: what every candidate scored on how many rows."""

    best: DataFrame
    rungs: DataFrame
    cache: DataFrame


def rung_sizes(rows: int, first: int, eta: int) -> list[int]:
    """Rows of each rung: ``first``, then ``eta`` times as many each, and all of them at last."""
    sizes = []
    size = min(max(first, 1), rows)
    while size < rows:
        sizes.append(size)
        size *= eta
    return [*sizes, rows]


def race_exemplars(
    task: DataFrame,
    keys: Sequence[str],
    prompts: Sequence[str],
    predict: Predict,
    n_exemplars: int = 3,
    seeds: Sequence[int] = (42,),
    cache: DataFrame | None = None,
    first_rows: int = 1_000,
    eta: int = 2,
    seed: int = 42,
    match: Callable[[Column, Column], Column] | None = None,
) -> ExemplarRace:
    """The best examples to put before each prompt, by successive halving on the task.

    Each (prompt, seed) draws a candidate of ``n_exemplars`` examples. A candidate's score is
    its mean score over the rows of a rung. Rungs are prefixes of one hash order of the task,
    so they are nested: a pair that was predicted for a rung is answered by the cache in all
    later ones. After each rung the best ``1 / eta`` of a prompt's candidates (rounded up) go
    on; the last rung is the whole task, and decides. Of equal scores the lowest seed wins, a
    candidate without a score is the worst. Repeated prompts and seeds count once; a task
    without rows gives no candidate. The driver sees one row per candidate and rung.
    """
    if eta < 2:
        raise ValueError("a rung must cut the candidates: eta is 2 or more")
    given, drawn = list(dict.fromkeys(prompts)), list(dict.fromkeys(seeds))
    known = empty_cache(task) if cache is None else cache
    spark = task.sparkSession
    texts = ops.exemplars_random(task, keys, given, n_exemplars, drawn).collect() if given and drawn else []
    open_: dict[str, list[tuple[int, str]]] = {}
    for r in sorted(texts, key=lambda r: r["seed"]):
        open_.setdefault(r["prompt"], []).append((r["seed"], r["text"]))
    history: list[tuple[str, int, int, int, float | None]] = []
    best: list[tuple[str, int, str, float | None]] = []
    sizes = rung_sizes(task.count(), first_rows, eta) if open_ else []
    for rung, size in enumerate(sizes):
        # One candidate left: it need not race before the last rung.
        racing = {p: c for p, c in open_.items() if len(c) > 1 or rung == len(sizes) - 1}
        asked = list(dict.fromkeys(text for c in racing.values() for _, text in c))
        if not asked:
            continue
        collected, known = evaluate(task, keys, asked, predict, known, "subsample", size, seed=seed, match=match)
        found = {r["prompt"]: r["score"] for r in ops.prompt_scores(collected).collect()}
        for prompt, candidates in racing.items():
            history += [(prompt, s, rung, size, found.get(text)) for s, text in candidates]
            value = {s: -1.0 if found.get(text) is None else found[text] for s, text in candidates}
            order = sorted(candidates, key=lambda c: (-value[c[0]], c[0]))
            open_[prompt] = order[: -(-len(order) // eta)]
            if rung == len(sizes) - 1:
                best.append((prompt, *order[0], found.get(order[0][1])))
    return ExemplarRace(
        spark.createDataFrame(best, "prompt string, seed int, text string, score double"),
        spark.createDataFrame(history, "prompt string, seed int, rung int, rows long, score double"),
        known,
    )


def run_evaluation(
    task: DataFrame, keys: Sequence[str], prompts: Sequence[str], predict: Predict, **options
) -> DataFrame:
    """Prompts ranked by their mean score."""
    collected, _ = evaluate(task, keys, prompts, predict, **options)
    return ops.prompt_leaderboard(ops.prompt_scores(collected))


def run_experiment(
    task: DataFrame,
    keys: Sequence[str],
    prompts: Sequence[str] | Callable[[DataFrame], Sequence[str]],
    predict: Predict,
    frac: float = 0.8,
    seed: int = 42,
    n_exemplars: int = 0,
) -> DataFrame:
    """Split, choose prompts on the training part, rank them on the rest.

    ``prompts`` is a list or a function of the training rows. With ``n_exemplars``, that
    many training examples are put before every prompt.
    """
    marked = split_random(task, keys, frac, seed, "__train")
    train = marked.where("__train").drop("__train")
    chosen = list(prompts(train) if callable(prompts) else prompts)
    if n_exemplars:
        texts = ops.exemplars_random(train, keys, chosen, n_exemplars, [seed])
        found = {r["prompt"]: r["text"] for r in texts.collect()}
        chosen = [found.get(p, p) for p in chosen]
    test = marked.where(~F.col("__train")).drop("__train")
    return run_evaluation(test, keys, chosen, predict)
