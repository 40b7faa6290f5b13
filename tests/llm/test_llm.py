"""The operators over text against brute force, on small and awkward tables."""

import collections
import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions

import corpus_pipeline
from columnwright.llm import (fingerprints, importance, linerules, mixing, packing, queries, simhash, suffixes,
                              tokens, toxicity, urls)
from columnwright.llm.words import chunks

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tile int, h long, place long"
WORDS = ["the", "of", "Été", "naïve", "over", "data", "spark", "###", "one|", "a", "it's", "42"]


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))
    passage = prose(120)
    texts = [None, "", " \n\t ", "a", "one two three", prose(300), prose(60) + passage + prose(50), passage,
             "x" + passage + "\n" + prose(80), "ab " * 400, prose(4000), prose(90) + "\n" + prose(90)]
    texts += [texts[5], texts[5][:-3] + "zzz", texts[10], texts[7]]
    out = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None, i, i, i) for i, t in enumerate(texts)]
    out += [out[6], out[6], (None, prose(70), None, None, None, 0, 0, 0), (None, texts[5], None, "s1", None, 0, 0, 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    queries.importable(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (6, 1, 0), (9, 0, 1), (9, 0, 1), (None, 1, 1), (7, None, None)],
                                 "doc_id long, quality int, toxic int")


def words(text):
    return (text or "").encode().split()


def brute_fingerprint(text):
    w = [x.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for x in words(text)]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(values, radius=4):
    root = {v: v for v in values}
    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_simhash_groups_equal_brute_force(docs, rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    groups = brute_groups(set(fps))
    least = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[groups[f]] = min(r[0], least.get(groups[f], r[0]))
    want = collections.Counter((r[0], f"{f:016x}", least.get(groups[f])) for r, f in zip(rows, fps))
    got = collections.Counter(map(tuple, simhash.near_duplicates(docs).collect()))
    assert got == want


def test_tiles_find_all_links_of_crowded_values(spark):
    rng = random.Random(1)
    values = set()
    for _ in range(40):
        v = rng.getrandbits(64)
        for _ in range(12):
            values.add(v)
            v ^= 1 << rng.randrange(64)
    values = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    links = simhash.near_links(df, tile_rows=16).collect()
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in links)
    root = {v: v for v in values}
    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for a, b in links:
        root[find(a % (1 << 64))] = find(b % (1 << 64))
    want = brute_groups(values)
    assert len(set(map(find, values))) == len(set(want.values()))


def test_one_document_of_each_group_stays(docs, rows):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and 12 not in ids and 5 in ids and 6 in ids


def test_groups_with_repeated_and_missing_ids_keep_one_row_each(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (3, a), (None, c), (None, c), (None, a), (5, None), (4, "")]
    kept = simhash.keep_first(spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, fp long, least string"))
    assert kept.columns == ["doc_id", "text", "fp", "least"]
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (None, c), (4, "")], key=str)


def brute_removal(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_removed_bytes_equal_brute_force(docs, rows):
    want = collections.Counter((r[0], *x) for r, x in zip(rows, brute_removal([r[1] for r in rows])))
    assert collections.Counter(map(tuple, suffixes.removal(docs).collect())) == want
    assert sum(x[2] for x in want) > 0


def test_hot_anchors_give_the_same_spans(docs, rows):
    plain = suffixes.repeated_spans(docs).collect()
    hot = suffixes.repeated_spans(docs, hot_contexts=1).collect()
    view = lambda found: {(r["t1"], r["t2"]): (r["copies"], suffixes.union_of(r["spans"] or [])) for r in found}
    assert view(plain) == view(hot)


def test_shared_edges_are_exact_to_the_byte(spark):
    rng = random.Random(3)
    letters = "abcdefgh"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    base = text(700)
    texts = [text(50) + base[a:b] + text(50) for a, b in ((0, 399), (0, 400), (100, 650), (250, 700), (299, 700), (301, 700))]
    texts += ["é" * 500, "z" * 399, "z" * 400, text(10) + "q" * 402]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, suffixes.removal(df).collect()))
    assert got == [(i, *x) for i, x in enumerate(brute_removal(texts))]


def test_loser_tree_merges_and_measures_prefixes():
    rng = random.Random(2)
    for k in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(20))) for _ in range(k)]
        order, prefixes = suffixes.merge_runs([suffixes.front_code(r) for r in runs])
        merged = [runs[r][i] for r, i in order]
        assert merged == sorted(x for r in runs for x in r)
        assert prefixes[1:] == [len(os.path.commonprefix([a, b])) for a, b in zip(merged, merged[1:])]


def test_cleaned_texts_keep_rows_and_columns(docs, rows):
    cleaned = suffixes.remove_repeats(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    assert {r["n_chars"] for r in cleaned.collect() if r["text"] is not None} >= {0}


def test_encoder_equals_the_library():
    tool = tokens.Encoder(tokens.tokenizer_path())
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab tre'é中1٣ \n\t　.,!''  'llvemd\U0001f600\r") for _ in range(rng.randrange(50))) for _ in range(3000)]
    texts += ["", "<|endoftext|>a", "'s", "it's we'll 'tis", " "]
    got = [ids[a:b].tolist() for _, _, ids, o in tool.encode(texts) for a, b in zip(o[:-1], o[1:])]
    assert got == [tool.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("width", [1, 7, 13, 16, 17, 32])
def test_packed_ids_come_back(width):
    ids = np.random.default_rng(width).integers(0, min(1 << width, 1 << 31), 999).astype(np.uint32)
    packed = tokens.pack(ids, width)
    assert len(packed) == -(-999 * width // 8)
    assert (tokens.unpack(packed, width, 0, 999) == ids).all() and (tokens.unpack(packed, width, 70, 9) == ids[70:79]).all()


def ids_of(text, end):
    tool = tokens.encoder(tokens.tokenizer_path())
    return np.array([*tool.tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files_round_trip(docs, rows):
    got = sorted((r["start"], r["n_tokens"], r["doc_id"], r["ids_crc32"]) for r in tokens.token_table(docs).collect())
    raw = [(r[0], ids_of(r[1], 2)) for r in rows]
    assert collections.Counter((d, n, c) for _, n, d, c in got) == collections.Counter((d, len(i), zlib.crc32(i)) for d, i in raw)
    at, last = 0, -1
    for start, n, doc, _ in got:
        assert start == at and (doc is None or doc >= last)
        at, last = at + n, -1 if doc is None else doc


def test_random_access_reads_wanted_documents(spark, docs, rows):
    path = queries.tokens.fresh_path(spark, "blocks")
    tokens.write_blocks(docs, path, tokens.tokenizer_path(), 2, block_ids=500, range_bytes=5000)
    got = {r["doc_id"]: bytes(r["ids"]) for r in tokens.read_documents(spark, path, [4, 10]).collect()}
    assert got == {i: ids_of(rows[i][1], 2).tobytes() for i in (4, 10)}


def test_packing_covers_every_id_once(docs, rows):
    pieces = packing.pack_documents(docs, with_ids=True).collect()
    assert sum(p["length"] for p in pieces) == sum(len(ids_of(r[1], 0)) for r in rows)
    windows = collections.defaultdict(list)
    for p in pieces:
        assert p["ids_crc32"] == zlib.crc32(bytes(p["ids"])) and len(p["ids"]) == 4 * p["length"]
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    by_doc = collections.defaultdict(list)
    for p in pieces:
        if p["doc_id"] is not None and p["doc_id"] != 6:
            by_doc[p["doc_id"]].append((p["start"], bytes(p["ids"])))
    for doc, parts in by_doc.items():
        assert b"".join(x for _, x in sorted(parts)) == ids_of(rows[doc][1], 0).tobytes()


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(0).integers(1, 257, 500)
    window, sums = packing.differencing(sizes, 64)
    assert (np.bincount(window, sizes, 64) == sums).all() and sums.max() - sums.min() <= 16


def test_line_rule_counts_equal_brute_force(docs, rows):
    model = linerules.plain_model()
    got = collections.Counter(tuple(r)[:7] for r in linerules.score_documents(docs, model).collect())
    want = collections.Counter()
    for r in rows:
        text, w = r[1] or "", words(r[1])
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = collections.Counter(windows)
        covered = {i + j for i, x in enumerate(windows) if count[x] > 1 for j in range(3)}
        lines, seen, dup = text.split("\n"), set(), 0
        for line in lines:
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[r[0], len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed] += 1
    assert got == want


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(4)
    model = linerules.LineModel(rng.normal(size=(2, 3)), rng.normal(size=(2, 2)), rng.normal(size=2))
    text = np.repeat(np.arange(6), [1, 5, 2, 7, 1, 3])
    x = rng.normal(size=(len(text), 3))
    found = linerules.viterbi(model, text, x)
    for t in range(6):
        at = np.flatnonzero(text == t)
        def score(states):
            s = x[at] @ model.emit.T
            total = model.begin[states[0]] + sum(s[i, k] for i, k in enumerate(states))
            return total + sum(model.move[a, b] for a, b in zip(states, states[1:]))
        best = max(([int(b) for b in np.binary_repr(m, len(at))] for m in range(1 << len(at))), key=score)
        assert score(best) == pytest.approx(score(found[at].tolist()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_line_rules_follow_the_quality_labels(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    kept = queries.op6(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").where("NOT base_failed").collect()
    good = [r["kept"] for r in kept if r["quality"] == 1]
    bad = [r["kept"] for r in kept if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_importance_counts_and_threshold(docs, rows, labels):
    got = importance.resample(docs, labels, share=0.5).collect()
    assert len(got) == len(rows)
    keys = sorted(r["gumbel_key"] for r in got)
    kept = [r["gumbel_key"] for r in got if r["kept"]]
    assert min(kept) >= keys[len(rows) // 2 - 1] and abs(len(kept) - len(rows) / 2) <= 2
    data = [r[1] for r in rows]
    raw = np.zeros(importance.BUCKETS, np.int64)
    for _, _, chunk in chunks(pa.array(data), lower=True):
        raw += np.bincount(importance.grams(chunk)[1], minlength=importance.BUCKETS)
    assert raw.sum() == sum(max(2 * len(words(t)) - 1, 0) for t in data)


def test_rows_that_tie_at_the_border_are_kept(spark):
    rows = [(None, "same words")] * 30 + [(i, f"other {i}") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = importance.resample(df, none, share=0.5).collect()
    tie = next(r["gumbel_key"] for r in got if r["doc_id"] is None)
    assert len({r["gumbel_key"] for r in got if r["doc_id"] is None}) == 1
    keys = sorted((r["gumbel_key"] for r in got), reverse=True)
    assert keys[19] == tie
    assert all(r["kept"] == (r["gumbel_key"] >= tie) for r in got) and sum(r["kept"] for r in got) >= 30


def test_importance_equals_a_second_version(spark, docs, rows, labels):
    """Counts, ratios, noise and the k largest keys, with loops over words."""
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["doc_id"] is not None}
    def bag(text):
        own = [w.lower() for w in words(text)]
        return collections.Counter(own) + collections.Counter(zip(own, own[1:]))
    raw, target = collections.Counter(), collections.Counter()
    for r in rows:
        raw += bag(r[1])
        if r[0] in good:
            target += bag(r[1])
    # A table this wide holds every n-gram in a bucket of its own, up to rare collisions.
    buckets = 1 << 22
    got = importance.resample(docs, labels, share=0.5, buckets=buckets).collect()
    n_raw, n_target = sum(raw.values()), sum(target.values())
    ratio = lambda g: np.log((target[g] + 1) / (n_target + buckets)) - np.log((raw[g] + 1) / (n_raw + buckets))
    want = collections.Counter()
    for r in rows:
        want[(r[0], round(sum(n * ratio(g) for g, n in bag(r[1]).items()), 4))] += 1
    same = collections.Counter((r["doc_id"], round(r["importance"], 4)) for r in got)
    assert sum((want & same).values()) >= len(rows) - 2
    keys = sorted((r["gumbel_key"] for r in got), reverse=True)
    border = keys[int(0.5 * len(rows) + 0.5) - 1]
    assert all(r["kept"] == (r["gumbel_key"] >= border) for r in got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(9)
    plain = [f"w{i}" for i in range(400)]
    data = []
    for i in range(3000):
        toxic = int(rng.random() < 0.3)
        text = [rng.choice(plain) for _ in range(60)]
        if toxic:
            text[rng.randrange(60)] = rng.choice(["Scum,", "trash", "moron!"])
        data.append((i, " ".join(text), toxic))
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    out = toxicity.classify(df, df.selectExpr("doc_id", "toxic")).join(df.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert {zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in out} == {0}
    assert sum(r["predicted"] == r["toxic"] for r in out) >= 0.97 * len(out)


def test_fingerprints_follow_their_definition(docs, rows):
    got = fingerprints.edited_likeness(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = collections.Counter()
    for r, after in zip(order, order[1:] + order[:1]):
        text, nxt = r[1] or "", after[1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        want[r[0], len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[5]["fingerprint"] == by_id[12]["fingerprint"] and by_id[0]["fingerprint"] == by_id[2]["fingerprint"]
    assert by_id[0]["near_next"] == 1.0 and by_id[1]["near_next"] == 1.0 and by_id[4]["near_next"] == 0.0
    assert by_id[12]["near_next"] > 0.8


def test_likeness_estimates_weighted_jaccard(spark):
    rng = random.Random(6)
    data, true = [], []
    for pair in range(15):
        a = [f"{pair}k{rng.randrange(60)}" for _ in range(300)]
        b = a[:200] + [f"{pair}k{rng.randrange(60, 120)}" for _ in range(100)]
        x, y = collections.Counter(a), collections.Counter(b)
        true.append(sum((x & y).values()) / sum((x | y).values()))
        data += [(2 * pair, " ".join(a)), (2 * pair + 1, " ".join(b))]
    df = spark.createDataFrame(data, "key long, text string")
    terms = df.select("key", fingerprints.sorted_terms(df["text"]).alias("terms"))
    got = {r["key"]: r["signature"] for r in fingerprints.signatures(terms, "key", "terms").collect()}
    found = [p == q for k in range(15) for p, q in zip(got[2 * k], got[2 * k + 1])]
    assert abs(np.mean(found) - np.mean(true)) < 0.08


def test_likeness_of_single_pairs_at_the_production_number(spark):
    rng = random.Random(8)
    texts, n = [], 60
    for k in range(n):
        a = [f"{k}k{rng.randrange(80)}" for _ in range(200)]
        texts += [" ".join(a), " ".join(a[: 150 - k] + [f"{k}n{rng.randrange(80)}" for _ in range(50 + k)])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.edited_likeness(df).collect()}
    assert len(got[0]["fingerprint"]) == 8 * fingerprints.SAMPLES
    errors = []
    for k, (text, after) in enumerate(zip(texts, texts[1:] + texts[:1])):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        x = collections.Counter(text.split())
        for name, other in (("near_edited", edited), ("near_next", after)):
            y = collections.Counter(other.split())
            errors.append(got[k][name] - sum((x & y).values()) / sum((x | y).values()))
    # 0.044 is the standard error at a likeness of a half, the largest there is.
    assert max(map(abs, errors)) < 4 * 0.0442 and np.sqrt(np.mean(np.square(errors))) < 0.044
    assert abs(np.mean(errors)) < 0.01


def least_draws(text, samples):
    """The sample of every number, from all draws of all pairs (term, number) of the text."""
    hash_ = lambda data, seed: xxhash.xxh64_intdigest(data, seed)
    whole = lambda x: x.to_bytes(4, "little", signed=True)
    pairs = []
    for word, count in collections.Counter(words(text)).items():
        term = hash_(word, 42) & ~1
        first = hash_(term.to_bytes(8, "little"), 42)
        pairs += [hash_(whole(i), first) for i in range(1, count + 1)]
    out = []
    for j in range(samples):
        least = None
        for pair in pairs:
            seed, levels = hash_(pair.to_bytes(8, "little"), 42), fingerprints.LEVELS
            above = next((i for i in range(levels) if not hash_(whole(-i - 1 - j // 64 * levels), seed) >> j % 64 & 1), levels)
            rest = (hash_(whole(j), seed) & ((1 << 59) - 1)) >> 32
            draw = (levels - above, rest, pair & 0xFFFFFFFF)
            least = draw if least is None else min(least, draw)
        out.append(least[2])
    return out


@pytest.mark.parametrize("least", [1, 10])
def test_samples_are_the_least_of_all_draws(spark, monkeypatch, least):
    # With 1 many samples are without a draw at first and are worked out from all pairs.
    monkeypatch.setattr(fingerprints, "LEAST", least)
    rng = random.Random(11)
    texts = [" ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n)) for n in (1, 3, 25, 90, 400)]
    texts += ["ab " * 300, "ab " * 90 + texts[3]]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    terms = df.select("key", fingerprints.sorted_terms(df["text"]).alias("terms"))
    got = {r["key"]: r["signature"] for r in fingerprints.signatures(terms, "key", "terms", 70).collect()}
    assert got == {i: least_draws(t, 70) for i, t in enumerate(texts)}


def test_two_texts_have_the_samples_of_each(spark, docs, rows, monkeypatch):
    got = [(r["doc_id"], r["fingerprint"], r["edited_sha256"], r["edited_fingerprint"]) for r in
           fingerprints.edited_likeness(docs, 64).collect()]
    monkeypatch.setattr(fingerprints, "LEAST", 1)
    again = [(r["doc_id"], r["fingerprint"], r["edited_sha256"], r["edited_fingerprint"]) for r in
             fingerprints.edited_likeness(docs, 64).collect()]
    assert collections.Counter(got) == collections.Counter(again)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    sign = lambda t: "".join(f"{x:08x}" for x in least_draws(t, 64)) if words(t) else "-" * 8 * 64
    want = collections.Counter()
    for r, after in zip(order, order[1:] + order[:1]):
        text, nxt = r[1] or "", after[1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        if len(text) < 9000:
            want[r[0], sign(text), hashlib.sha256(edited.encode()).hexdigest(), sign(edited)] += 1
    assert not want - collections.Counter(got) and len(want) > 10


def test_few_draws_are_worked_out(spark):
    rows = [(i, i, 5) for i in range(400)]
    pairs = spark.createDataFrame(rows, "key long, __pair long, __level int")
    entered = fingerprints._entered(pairs, ["key"], 128).count()
    assert abs(entered - 400 * 128 / 32) < 200


def test_followers_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 200)
    texts = [" ".join(f"w{i // 2}x{j}" for j in range(30)) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["near_next"] for r in fingerprints.edited_likeness(df).collect()}
    assert got == {i: float(i % 2 == 0) for i in range(40)}


def test_a_task_holds_one_range_of_bounded_weight(spark, monkeypatch):
    # Many short texts, then long ones that lie together; three rows have no id, one id comes twice.
    texts = [f"a{i} b{i // 2}" for i in range(300)] + [" ".join(f"{i}w{j % 900}" for j in range(6000)) for i in range(6)]
    data = [(None if i < 3 else 10 if i == 11 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    whole = collections.Counter(map(tuple, fingerprints.edited_likeness(df, 64).collect()))
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 40_000)
    part = functions.spark_partition_id().alias("part")
    rows = fingerprints.with_next(df).select(part, "range", "border", functions.octet_length("text").alias("bytes")).collect()
    assert len(rows) == len(data) + len({r["range"] for r in rows})
    assert len({r["part"] for r in rows}) == len({(r["part"], r["range"]) for r in rows}) > 30
    weight = collections.Counter()
    for r in rows:
        weight[r["part"]] += (1 - r["border"]) * (4096 + r["bytes"])
    assert max(weight.values()) < 2 * 40_000
    assert collections.Counter(map(tuple, fingerprints.edited_likeness(df, 64).collect())) == whole


def test_fingerprint_plan_has_no_python(spark, docs):
    plan = fingerprints.edited_likeness(docs)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "ArrowEval", "MapInArrow"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_url_verdicts_equal_the_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    want = sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.ORACLES['op8_url_cascade']})").fetchall())
    assert sorted(map(tuple, queries.op8(spark, SF).collect())) == want


@pytest.mark.parametrize("slice_bytes", [32_000_000, 400])
def test_cascade_is_exact(spark, slice_bytes):
    keys = spark.createDataFrame([(f"h{i}/p",) for i in range(3000)] + [("",), ("h1/p",)], "key string")
    listed = spark.createDataFrame([(f"h{i}/p",) for i in range(0, 3000, 7)] + [("elsewhere",)], "key string")
    got = urls.blocked(keys, listed, slice_bytes=slice_bytes).collect()
    assert len(got) == 3002
    assert all(r["listed"] == (r["key"] != "" and int(r["key"][1:-2]) % 7 == 0) for r in got)


def test_url_edge_cases(spark):
    pages = spark.createDataFrame(
        [(1, None), (2, "no scheme"), (3, "http://A.B.NET/x?y"), (4, "http://x.example.net/en/1#t"), (5, "http://example.com/de"),
         (5, "http://example.com/de/"), (None, "ftp://net?q"), (6, "http://notnet/")], "page_id long, url string")
    none = spark.createDataFrame([], "key string")
    got = {(r["page_id"], r["path"]): (r["host"], r["rule"], r["verdict"]) for r in urls.judge(pages, queries.RULES, none).collect()}
    assert got[1, ""] == got[2, ""] == ("", None, "allow")
    assert got[3, "/x"] == ("a.b.net", "net/", "block") and got[4, "/en/1"][1:] == ("example.net/en/", "allow")
    assert got[5, "/de"][1] is None and got[5, "/de/"][2] == "block" and got[None, ""] == ("net", None, "allow")
    assert got[6, "/"] == ("notnet", None, "allow")


def test_mixture_meets_the_repetition_limit(spark):
    data = [(i, "w " * 10, "big" if i < 900 else "mid" if i < 1000 else "small") for i in range(1030)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.placed(df, max_repeats=2.0).selectExpr("__row.doc_id id", "__row.source s", "weight").collect()
    times = collections.Counter(r["id"] for r in got)
    assert set(times) == set(range(1030)) and max(times.values()) == 2
    spent = collections.Counter(r["s"] for r in got)
    assert spent["big"] == 900 and spent["small"] == 60 and 100 < spent["mid"] < 200
    weights = {r["s"]: r["weight"] for r in got}
    assert sum(weights.values()) == pytest.approx(1.0)
    assert spent["mid"] / sum(spent.values()) == pytest.approx(weights["mid"], abs=0.01)


def test_entropy_target(spark):
    totals = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, tokens long")
    found = mixing.temperature(totals, entropy_share=0.8)
    p = np.array([0.9, 0.09, 0.01]) ** found.exponent
    p /= p.sum()
    assert -(p * np.log(p)).sum() == pytest.approx(0.8 * np.log(3), abs=1e-6)


def test_mixture_of_awkward_rows_keeps_them(docs, rows):
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert {r["doc_id"] for r in mixed.collect()} == {r[0] for r in rows}


def test_empty_tables_give_empty_tables(spark, empty, labels):
    none = labels.limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0
    assert suffixes.removal(empty).count() == 0 and suffixes.remove_repeats(empty).count() == 0
    assert importance.resample(empty, none).count() == 0 and packing.pack_documents(empty).count() == 0
    assert toxicity.classify(empty, none).count() == 0 and tokens.token_table(empty).count() == 0
    assert linerules.score_documents(empty, linerules.train(empty, none)).count() == 0
    assert fingerprints.edited_likeness(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge(pages, queries.RULES, urls.noticed_addresses(pages, "x")).count() == 0


def test_awkward_rows_are_scored(docs, rows, labels):
    assert toxicity.classify(docs, labels).count() == len(rows)
    assert linerules.keep_documents(docs, linerules.train(docs, labels)).columns == docs.columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stages_apply_in_order(spark):
    queries.importable(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.store(stage(spark, docs, SF), name).df
        counts.append(docs.count())
        if name != "pack":
            assert docs.columns == columns
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2] and counts[4] >= counts[3]
