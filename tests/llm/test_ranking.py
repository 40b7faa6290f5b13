"""Ranked search against a plain loop over all documents."""

import collections
import math
import os
import random
import re

import numpy as np
import pytest

from columnwright.llm import queries, ranking

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """(item, rank, doc, score) by scoring every pair."""
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, total = len(bags), sum(x[2] for x in bags)
    df = collections.Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set(items):
        scored = []
        for doc, bag, size in bags:
            m = 100 - 75 + (75 * size * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m))
                for t in terms(text) if t in bag
            )
            if score > 0:
                scored.append((-score, doc is not None, doc or 0))
        out += [(item, rank, e[2] if e[1] else None, -e[0]) for rank, e in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def tables():
    """Ties, copies, nulls, empty and long texts, terms that occur nowhere, repeated items."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "ÄÖ", "naïve", "42", "A1"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choices(vocabulary, k=n))
    docs = [(i, text(rng.choice([1, 3, 20, 60]))) for i in range(500)]
    docs += [(1000 + i, "w1 w2 w3 copy") for i in range(60)] + [(1000, "w1 w2 w3 copy"), (None, "w1 w2 w3 copy")]
    docs += [(2000, None), (2001, ""), (2002, " .,; "), (2003, "w5 " * 30_000), (2003, "w5"), (-4, "été w1")]
    items = [(i, text(rng.choice([1, 4, 40]))) for i in range(30)]
    items += [(100, "w1 w2 w3"), (100, "w1 w2 w3"), (100, "w9 w9 w9"), (101, None), (102, ""), (103, "nowhere"), (None, "W1 w1")]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("sizes", [{}, {"ITEM_BYTES": 300, "CELLS": 500, "BLOCK_ITEMS": 5, "BLOCK_TERMS": 20, "seed": 50}])
def test_search_equals_brute_force(spark, tables, monkeypatch, sizes):
    docs, items = tables
    seed = sizes.pop("seed", 20_000)
    limit = sizes.pop("ITEM_BYTES", ranking.ITEM_BYTES)
    monkeypatch.setattr(ranking.item_groups, "__defaults__", (limit,))
    for name, value in sizes.items():
        monkeypatch.setattr(ranking, name, value)
    a = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, item long, n string")
    b = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score int")
    assert found(ranking.rank(a, b, seed_docs=seed)) == brute(docs, items)


def test_walk_leaves_most_pairs_out():
    """Documents of other vocabularies are not scored at all."""
    items = ranking._items([(i, f"a{i} b{i} c{i}") for i in range(64)])
    size = len(items.vocabulary)
    search = ranking.Search(items, np.full(size, 1000), 1000, 3000, np.ones(64, np.int64), 2)
    rows = np.repeat(np.arange(640), 3)
    own = [items.terms[i % 64] for i in range(640)]
    search.show(list(range(640)), np.full(640, 3), rows, np.concatenate(own), np.ones(1920, np.int64))
    assert all([e[2] for e in search.best[i]] == [i, i + 64] for i in range(64))
    assert search.scored < search.pairs / 4


def test_empty_tables(spark, tables):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert ranking.rank(docs, items).count() == 0
    some = spark.createDataFrame([(1, "w1")], "doc_id long, text string")
    assert ranking.rank(some, items.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_on_whole_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(queries.QUERIES["op13_dual_tree_search"](spark, SF)) == brute(docs, items)
