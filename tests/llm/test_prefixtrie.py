"""The conversation trie against a plain dictionary of prefixes."""

import collections
import hashlib
import os
import random
import zlib

import pytest

from columnwright.llm import prefixtrie, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "conv_id long, turn long, role string, text string, shard int, b int"


def rebuilt(rows):
    """conv -> its turns after the head of its host was put in front."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    def order(t):
        digest = hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()
        signed = [int.from_bytes(bytes.fromhex(digest[i : i + 16]), "big", signed=True) for i in (0, 16)]
        return (t[0], t[1], t[2].encode(), *signed)
    plain = {c: [(t[2], t[3]) for t in sorted(ts, key=order)] for c, ts in own.items()}
    return {
        c: plain.get(c - int(c - 100 * int(c / 100)), [])[: zlib.crc32(str(c).encode()) % 6] + ts[zlib.crc32(str(c).encode()) % 6 :]
        for c, ts in plain.items()
    }


def brute(turns):
    """All nodes by a dictionary from prefix to members."""
    members, children, ends = collections.defaultdict(list), collections.defaultdict(set), collections.defaultdict(list)
    for c in sorted(turns):
        ts = tuple(turns[c])
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
            if d:
                children[ts[: d - 1]].add(ts[:d])
        ends[ts].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, ())
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    sha = lambda node: hashlib.sha256(",".join(map(str, ends.get(node, []))).encode()).hexdigest()
    return sorted(
        (members[n][0], len(n), members[n[:-1]][0] if n else -1, len(members[n]), len(children.get(n, ())), leaves[n], saved[n], sha(n))
        for n in members
    )


def found(df):
    return sorted(
        (r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"],
         r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"])
        for r in df.collect()
    )


@pytest.fixture(scope="module")
def rows():
    """Copies, shared heads, long ones, ties, nulls, negative ids, missing hosts."""
    rng = random.Random(3)
    out = []
    texts = ["", "a", "été", "long " * 50, None]
    for c in [*range(0, 40), *range(100, 140), *range(205, 260), -7, -250, -300]:
        for turn in range(rng.choice([1, 2, 3, 5, 9, 23])):
            out.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(texts)))
    for c in range(1000, 1200):  # copies of one long conversation, some of them cut short
        out += [(c, turn, "user", f"copy {turn}") for turn in range(40 if c % 3 else 16)]
    out += [(300, None, None, None), (300, None, "user", None), (300, 4, "b", "x"), (300, 4, "a", "x"), (300, 4, "a", "x")]
    out += [(None, 1, "user", "nobody"), (301, 0, "user", "z" * 100_000)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("width, shard_rows", [(4, 10), (16, 100_000), (1, 50)])
def test_trie_equals_brute_force(spark, rows, width, shard_rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    assert found(prefixtrie.rebuilt_trie(df, width, shard_rows)) == brute(rebuilt(rows))


def test_trie_without_rebuilding(spark):
    rows = [(c, t, "user", f"t{min(c, 2)}{t}") for c in range(6) for t in range(c + 1)]
    turns = collections.defaultdict(list)
    for c, _, role, text in rows:
        turns[c].append((role, text))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(prefixtrie.conversation_trie(df, 2, 3)) == brute(turns)


def test_empty_table(spark):
    assert prefixtrie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.QUERIES["op11_prefix_trie"](spark, SF)) == brute(rebuilt(rows))
