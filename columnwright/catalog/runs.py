"""Whole augmentation rounds on the labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from columnwright.catalog.frames import QUALITY_KEYS, quality
from columnwright.catalog.registry import query
from columnwright.plans import rounds

START = ["n_chars", "lang"]
SOURCES = ["letter_share", "unique_share", "source"]
BATCHES = [
    [
        {"name": "letters", "op": "expr", "input": ["letter_share"], "args": {"sql": "letter_share"}},
        {"name": "length_band", "op": "bin_quantile", "input": ["n_chars"],
         "args": {"labels": ["short", "medium", "long", "huge"]}},
    ],
    [{"name": "broken", "op": "bin_fixed_width", "input": ["no_such_column"], "args": {"size": 3}}],
    [
        {"name": "variety", "op": "pct_rank", "input": ["unique_share"]},
        {"name": "source_size", "op": "group_transform", "input": ["unique_share"],
         "args": {"by": ["source"], "agg": "avg"}},
        {"name": "leak", "op": "expr", "input": [], "args": {"sql": "quality"}},
    ],
]


def _setup():
    return rounds.Setup(QUALITY_KEYS, "quality", folds=5, sources=SOURCES)


def _run(spark, sf, batches):
    df = quality(spark, sf)
    return rounds.augment_run(df, START, batches, _setup())


def _readable(frame):
    scores = [F.round(c, 6).alias(c) for c in ("score_before", "score_added", "score_pruned")]
    return frame.select("round", "status", "suggestions", F.array_join("selected", ",").alias("selected"),
                        *scores, "accepted")


@query("augment_round")
def augment_round(spark, sf):
    return _readable(_run(spark, sf, BATCHES[:1]).ledger_frame())


@query("augment_run")
def augment_run(spark, sf):
    return _readable(_run(spark, sf, BATCHES).ledger_frame())
