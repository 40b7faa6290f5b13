"""Languages: the path against plain Viterbi, spans of mixed texts, held-out rows."""

import os
import random
import zlib

import numpy as np
import pytest

from columnwright.llm import languages, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, held_out int, spans int"
SETS = {
    "aa": ["the", "thing", "with", "that", "weather", "other"],
    "bb": ["ocho", "niño", "cabeza", "puerta", "lluvia", "sol"],
    "cc": ["мир", "вода", "книга", "солнце", "дом"],
}


def prose(rng, lang, n):
    return " ".join(rng.choices(SETS[lang], k=n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, 40), lang, None, 0, 0) for i, lang in enumerate(list(SETS) * 40)]
    rows += [(500, None, "aa", None, 0, 0), (501, "x", None, None, 0, 0), (502, "the", "", None, 0, 0)]
    return languages.train(spark.createDataFrame(rows, SCHEMA), 1 << 12)


def plain_viterbi(scores, penalty):
    """Score of the best path."""
    best = scores[0].copy()
    for row in scores[1:]:
        best = np.maximum(best, best.max() - penalty) + row
    return best.max()


@pytest.mark.parametrize("width", [1, 2, 5])
def test_path_is_the_best_one(width):
    rng = np.random.default_rng(width)
    counts = [0, 1, 5, 31, 32, 33, 0, 64, 500]
    at = np.concatenate([[0], np.cumsum(counts)])
    scores = rng.normal(size=(at[-1], width)) * 2
    label = languages.viterbi(scores, at, 3.0)
    for a, z in zip(at[:-1], at[1:]):
        if z > a:
            path = label[a:z]
            own = scores[np.arange(a, z), path].sum() - 3.0 * (path[1:] != path[:-1]).sum()
            assert own == pytest.approx(plain_viterbi(scores[a:z], 3.0))


def test_mixed_text_is_cut_into_spans(spark, model):
    rng = random.Random(2)
    parts = [("aa", prose(rng, "aa", 30)), ("bb", prose(rng, "bb", 40)), ("cc", prose(rng, "cc", 20)), ("aa", prose(rng, "aa", 50))]
    text = "123 " + " -- ".join(p for _, p in parts)
    df = spark.createDataFrame([(1, text, None, None, 0, 0)], SCHEMA)
    row = languages.identify(df, model).first()
    assert [s["lang"] for s in row["spans"]] == [x for x, _ in parts]
    assert [text[s["start"] : s["end"]] for s in row["spans"]] == [p for _, p in parts]
    assert row["lang_pred"] == "aa" and row["score"] == pytest.approx(
        sum(c.isalpha() for x, p in parts if x == "aa" for c in p) / sum(c.isalpha() for c in text)
    )


def test_scripts_narrow_candidates(model):
    assert model.names == ["aa", "bb", "cc"]
    words = next(languages.word_chunks(__import__("pyarrow").array(["мир the 水"])))[2]
    scores = model.emissions(words)
    assert scores[0].argmax() == 2 and scores[1, 2] < scores[1, :2].min() and (scores[2] == 0).all()


def test_awkward_texts(spark, model):
    texts = [None, "", " 12 ## ", "水水水", "THE", "the " * 60_000 + "ocho", "thé ñ", "x"]
    df = spark.createDataFrame([(i, t, "zz", None, 0, 0) for i, t in enumerate(texts)] * 2 + [(None, "sol sol", None, None, 0, 0)], SCHEMA)
    got = [(r["doc_id"], r["lang_pred"], r["score"], r["held_out"]) for r in languages.identify(df, model).collect()]
    assert len(got) == 2 * len(texts) + 1 and len(set(got)) == len(texts) + 1
    by_id = {g[0]: g for g in got}
    assert [by_id[i][1] for i in range(3)] == ["und"] * 3 and [by_id[i][2] for i in range(3)] == [0.0] * 3
    assert by_id[3][1] in model.names and by_id[4][1] == "aa" and by_id[5][1] == "aa"
    assert by_id[None][1] == "bb" and by_id[None][3] is False
    assert all(g[3] == (zlib.crc32(str(g[0]).encode()) % 4 == 2) for g in got if g[0] is not None)


def test_empty_and_unlabelled_tables(spark, model):
    empty = spark.createDataFrame([], SCHEMA)
    assert languages.identify(empty, model).count() == 0
    none = languages.train(empty)
    assert none.names == []
    df = spark.createDataFrame([(1, "the", None, None, 0, 0)], SCHEMA)
    row = languages.identify(df, none).first()
    assert row["lang_pred"] == "und" and row["score"] == 0.0 and row["spans"] == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_rows_of_the_query(spark):
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op12_language_spans"](spark, SF).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"] and any(c.isalpha() for c in truth[r["doc_id"]][1] or "")]
    assert held and np.mean([r["lang_pred"] == truth[r["doc_id"]][0] for r in held]) > 0.9
