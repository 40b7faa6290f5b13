"""Prefix trie of conversations from padded turn-id matrices.

A conversation is a sequence of turns; a node of the trie is a distinct sequence of first turns.
Every turn gets a 128-bit id from its place, role and text, so texts are read once and never
shuffled. Conversations are cut into blocks of ``WIDTH`` turns; a block is one row of a matrix,
and the exclusive-or of all ids before it names the node it hangs on. Rows are range-sharded in
lexical order. A task sorts its shard with ``numpy.lexsort``; the column changes between
neighbouring rows, OR-accumulated from left to right, say where nodes start, and ``reduceat``
adds up every depth.

Everything a node is asked for is a sum (or least value) over its rows once each row knows how
many turns it shares with the row before and after it:

* a child of the node starts where the shared turns end at the node's depth,
* a row that shares its whole length with no later row is one leaf,
* turns that a row shares with the row before it are the saved ones.

So a node that lies across shards is the sum of its parts. The first and last rows of shards
are compared with their neighbours, which tells which nodes those are; only their parts, and
those at the border between two blocks, are shuffled again.

The members that end at a node are hashed as text in ascending order. Parts of that text come
from the shards in order and are streamed through the hash, so no list of members is held.

Defined results: turns of one conversation with equal turn numbers follow each other by role,
then by the hash of role and text; a null role or text is empty; rows without ``conv_id`` belong
to no conversation; a conversation left without turns is a member of the root only; a turn with
empty role and text is a turn, and so is each of several equal rows;
the remainder of a negative ``conv_id`` has its sign, as in SQL; very long texts only enter their
hash and length; an empty table gives an empty table; other columns are ignored. A conversation's
turns are numbered in one sorted window of small rows, which spills if it has to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from columnwright.storage import scratch, store

WIDTH = 16
SHARD_ROWS = 100_000
HOST_STEP, MAX_HEAD = 100, 6
PAD = np.iinfo(np.int64).min
# Ids of members in one part of the text that is hashed for a node.
PART_IDS = 500

ROWS = "b int, p0 long, p1 long, ids array<long>, lens array<long>, more boolean, conv long"
SORTED = ROWS + ", shard int, place int, last boolean, shared int, next_shared int"
NODES = (
    "b int, shard int, depth long, k0 long, k1 long, q0 long, q1 long, conv long, parent_conv long, open boolean, "
    "parent_open boolean, n_convs long, n_children long, n_leaves long, saved_tokens long, part int, ends string, sha string"
)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1), t0, t1 (hash of role and text), n_chars of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    half = lambda i: F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long")
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"),
        half(0).alias("t0"), half(1).alias("t1"), F.char_length(text).cast("long").alias("n_chars"),
    )
    along = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "t0", "t1")
    return turns.select("conv", F.row_number().over(along).cast("long").alias("pos"), "t0", "t1", "n_chars")


def head_length(conv: Column) -> Column:
    """How many turns a conversation takes over from its host: crc32 of its decimal id, modulo 6."""
    return F.crc32(conv.cast("string").cast("binary")) % F.lit(MAX_HEAD)


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """Turns of the rebuilt conversations, and one row with a null ``pos`` for each without any.

    A conversation takes its first turns from its host, at most five of them, so a host hands
    out a bounded row to at most ``HOST_STEP`` conversations.
    """
    own = store(numbered_turns(conversations), "turns").df
    convs = own.groupBy("conv").agg(F.max("pos").alias("n")).withColumns(
        {"h": head_length(F.col("conv")), "host": F.col("conv") - F.col("conv") % F.lit(HOST_STEP)}
    )
    turn = F.struct("pos", "t0", "t1", "n_chars")
    heads = (
        own.where((F.col("conv") % HOST_STEP == 0) & (F.col("pos") < MAX_HEAD))
        .groupBy(F.col("conv").alias("host")).agg(F.sort_array(F.collect_list(turn)).alias("head"))
    )
    taken = F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array().cast("array<struct<pos:long,t0:long,t1:long,n_chars:long>>"))
    planned = store(convs.join(heads, "host", "left").select("conv", "n", "h", taken.alias("head")), "heads").df
    first = planned.select("conv", F.explode("head").alias("t")).select("conv", "t.*")
    rest = own.join(planned.select("conv", "h", F.size("head").alias("n_head")), "conv").where("pos > h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("n_head")).alias("pos"), "t0", "t1", "n_chars"
    )
    none = planned.where("n <= h AND size(head) = 0").select(
        "conv", *[F.lit(None).cast("long").alias(c) for c in ("pos", "t0", "t1", "n_chars")]
    )
    return first.unionByName(rest).unionByName(none)


def blocks(turns: DataFrame, width: int) -> DataFrame:
    """Rows of the matrix: at most ``width`` turns of one conversation each."""
    # The place is part of a turn's id: ids of a prefix can then be added up in any order.
    salted = lambda *names: F.greatest(F.xxhash64(*names), F.lit(int(PAD) + 1))
    turn = F.when(F.col("pos").isNotNull(), F.struct(
        "pos", salted("t0", "t1", "pos").alias("a"), salted("t1", "t0", "pos").alias("z"), "n_chars"
    ))
    b = F.coalesce(F.floor((F.col("pos") - 1) / width), F.lit(0)).cast("int")
    grouped = turns.select("conv", b.alias("b"), turn.alias("turn")).groupBy("conv", "b").agg(
        F.sort_array(F.collect_list("turn")).alias("turns"),
        F.coalesce(F.bit_xor("turn.a"), F.lit(0)).cast("long").alias("x0"),
        F.coalesce(F.bit_xor("turn.z"), F.lit(0)).cast("long").alias("x1"),
    )
    along = Window.partitionBy("conv").orderBy("b")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    ids = F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["z"])))
    return grouped.select(
        "b", F.coalesce(F.bit_xor("x0").over(before), F.lit(0)).cast("long").alias("p0"),
        F.coalesce(F.bit_xor("x1").over(before), F.lit(0)).cast("long").alias("p1"),
        ids.alias("ids"), F.col("turns.n_chars").alias("lens"),
        F.lead(F.lit(True)).over(along).isNotNull().alias("more"), "conv",
    )


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, length of each list) of a list column."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return np.asarray(column.flatten()), np.asarray(column.value_lengths()).astype(np.int64)


def _padded(values: np.ndarray, lengths: np.ndarray, pad: int) -> np.ndarray:
    """One row per list, filled up on the right."""
    width = int(lengths.max(initial=0))
    out = np.full((len(lengths), width), pad, np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one shard in order, with the number of turns shared with both neighbours.

    ``shared`` is -1 where the row before hangs on another node, or is in another shard.
    """
    held = list(batches)
    if not sum(len(x) for x in held):
        return
    rows = pa.Table.from_batches(held)
    values, lengths = _lists(rows["ids"])
    matrix = _padded(values, lengths, PAD)
    plain = {c: np.asarray(rows[c]) for c in ("b", "p0", "p1", "more", "conv")}
    lead = [plain["b"].astype(np.int64), plain["p0"], plain["p1"]]
    order = np.lexsort([plain["conv"], plain["more"], *matrix.T[::-1], *lead[::-1]])
    matrix, n = matrix[order], len(order)
    other = np.ones(n, bool)
    for x in lead:
        other[1:] &= x[order][1:] == x[order][:-1]
    other[0] = False
    # Once a column differs, all columns after it count as different.
    changed = np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1)
    shared = np.full(n, -1, np.int64)
    shared[1:] = (~changed).sum(1) // 2
    length = lengths[order] // 2
    shared[1:] = np.minimum(shared[1:], np.minimum(length[1:], length[:-1]))  # padding is no turn
    shared[~other] = -1
    out = rows.take(pa.array(order))
    extra = {
        "shard": np.full(n, TaskContext.get().partitionId(), np.int32), "place": np.arange(n, dtype=np.int32),
        "last": np.arange(n) == n - 1, "shared": shared.astype(np.int32),
        "next_shared": np.append(shared[1:], -1).astype(np.int32),
    }
    for name, x in extra.items():
        out = out.append_column(name, pa.array(x))
    yield from out.to_batches(max_chunksize=10_000)


def _borders(rows: DataFrame) -> DataFrame:
    """shard, first_shared, last_shared: turns its first and last row share with those next to them.

    One row per shard; the window runs over shards, not over conversations.
    """
    row = F.struct("b", "p0", "p1", "ids")
    ends = rows.where("place = 0 OR last").groupBy("shard").agg(
        F.min_by(row, "place").alias("first"), F.max_by(row, "place").alias("final")
    )
    along = Window.orderBy("shard")

    def common(x: str, y: str) -> Column:
        same_node = (F.col(f"{x}.b") == F.col(f"{y}.b")) & (F.col(f"{x}.p0") == F.col(f"{y}.p0")) & (F.col(f"{x}.p1") == F.col(f"{y}.p1"))
        same = F.zip_with(f"{x}.ids", f"{y}.ids", lambda a, b: F.coalesce(a == b, F.lit(False)))
        at = F.array_position(same, False)
        n = F.when(at == 0, F.size(same)).otherwise(at - 1)
        return F.when(same_node, F.floor(n / 2)).otherwise(-1).cast("int")

    found = ends.withColumn("before", F.lag("final").over(along)).withColumn("first_shared", F.coalesce(common("before", "first"), F.lit(-1)))
    return found.select("shard", "first_shared", F.coalesce(F.lead("first_shared").over(along), F.lit(-1)).alias("last_shared"))


def _later(rows: DataFrame, borders: DataFrame) -> DataFrame:
    """shard, place, saved, leaf: what the later blocks of a long conversation add to a row."""
    long = rows.where("b > 0 OR more").join(borders, "shard").withColumns({
        "shared": F.when(F.col("place") == 0, F.col("first_shared")).otherwise(F.col("shared")),
        "next_shared": F.when(F.col("last"), F.col("last_shared")).otherwise(F.col("next_shared")),
    })
    own = long.select(
        "conv", "b", "shard", "place",
        F.aggregate(F.slice("lens", F.lit(1), F.greatest("shared", F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x).alias("saved"),
        (~F.col("more") & (F.col("next_shared") < F.size("lens"))).cast("long").alias("leaf"),
    )
    after = Window.partitionBy("conv").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    return own.select(
        "shard", "place", F.coalesce(F.sum("saved").over(after), F.lit(0)).alias("saved"),
        F.coalesce(F.max("leaf").over(after), F.lit(0)).alias("leaf"),
    ).where("saved > 0 OR leaf > 0")


def _ends(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def _nodes(width: int):
    """A function of (rows of a shard, its borders and later sums) that gives its nodes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.sort_by("place")
        n = len(rows)
        fields = [f.split()[0] for f in NODES.split(", ")]
        out: dict[str, list] = {c: [] for c in fields}
        if not n:
            return pa.table({c: pa.array([], t) for c, t in _types().items()})
        values, lengths = _lists(rows["ids"])
        matrix = _padded(values, lengths, 0)
        lens = _padded(*_lists(rows["lens"]), 0)
        length = lengths // 2
        b, p0, p1, conv = (np.asarray(rows[c]) for c in ("b", "p0", "p1", "conv"))
        more, shard = np.asarray(rows["more"]), rows["shard"][0].as_py()
        shared, after = (np.array(rows[c]).astype(np.int64) for c in ("shared", "next_shared"))
        saved_later, leaf_later = np.zeros(n, np.int64), np.zeros(n, np.int64)
        places, first, last, saved, leaf = (np.asarray(right[c]) for c in ("place", "first_shared", "last_shared", "saved", "leaf"))
        at = places >= 0
        saved_later[places[at]], leaf_later[places[at]] = saved[at], leaf[at]
        if not at.all():
            shared[0], after[-1] = first[~at][0], last[~at][0]
        leaves = np.where(more, leaf_later, after < length)
        chars = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(lens, axis=1)], axis=1)
        to = np.maximum(shared, 0)
        upto = chars[np.arange(n), to]
        key0 = np.bitwise_xor.accumulate(np.column_stack([p0, matrix[:, 0::2]]), axis=1)
        key1 = np.bitwise_xor.accumulate(np.column_stack([p1, matrix[:, 1::2]]), axis=1)
        above = None
        for d in range(matrix.shape[1] // 2 + 1):
            own = np.flatnonzero(length >= d)
            if not len(own):
                break
            starts = np.flatnonzero(np.append(True, shared[own[1:]] < d))
            head = own[starts]
            ends = np.append(starts[1:], len(own))
            add = lambda x: np.add.reduceat(x[own].astype(np.int64), starts)  # noqa: E731, B023
            n_convs = ends - starts
            least = np.minimum.reduceat(conv[own], starts)
            children = add((length > d) & (shared <= d))
            tail = np.where(shared >= d, upto - chars[:, max(d - 1, 0)], 0) + saved_later
            cut = np.zeros(len(starts), bool)
            cut[0] |= own[0] == 0 and shared[0] >= d
            cut[-1] |= own[-1] == n - 1 and after[-1] >= d
            cut |= add(more & (length == d)) > 0  # its children are in the next block
            bridge = (b[head] > 0) & (d == 0)  # the node itself belongs to the block before
            done = (length == d) & ~more
            if d:
                parent = np.searchsorted(above[0], head, "right") - 1
                parent_conv, parent_open = above[1][parent], above[2][parent]
                q0, q1 = key0[head, d - 1], key1[head, d - 1]
            else:
                parent_conv, parent_open, q0, q1 = least, np.zeros(len(starts), bool), key0[head, 0], key1[head, 0]
            open_ = cut | bridge
            above = head, least, open_
            full = np.where(bridge, 0, 1)
            n_leaves, n_saved = add(leaves), add(tail)
            done_rows = done[own]
            for i in range(len(starts)):
                members = conv[own[starts[i]:ends[i]]][done_rows[starts[i]:ends[i]]]
                row = [
                    int(b[head[i]]), shard, int(b[head[i]]) * width + d, int(key0[head[i], d]), int(key1[head[i], d]), int(q0[i]), int(q1[i]),
                    int(least[i]) if full[i] else None, int(parent_conv[i]) if d and not parent_open[i] else None,
                    bool(open_[i]), bool(d and parent_open[i]), int(n_convs[i] * full[i]), int(children[i]),
                    int(n_leaves[i] * full[i]), int(n_saved[i] * full[i]),
                ]
                if not open_[i]:
                    row += [0, None, hashlib.sha256(_ends(members)).hexdigest()]
                    parts = [row]
                elif not len(members):
                    parts = [row + [0, None, None]]
                else:
                    texts = [_ends(members[j : j + PART_IDS]).decode() for j in range(0, len(members), PART_IDS)]
                    empty = row[:11] + [0, 0, 0, 0]
                    parts = [(row if j == 0 else empty) + [j, text, None] for j, text in enumerate(texts)]
                for part in parts:
                    for c, x in zip(fields, part):
                        out[c].append(x)
        kinds = _types()
        return pa.table({c: pa.array(x, kinds[c]) for c, x in out.items()})

    return run


def _types() -> dict[str, pa.DataType]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    return {f.split()[0]: kinds[f.split()[1]] for f in NODES.split(", ")}


def _stream_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """depth, k0, k1, sha of nodes whose parts of the text follow each other."""
    at, digest = None, None
    done: list[tuple] = []
    for batch in batches:
        for depth, k0, k1, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (depth, k0, k1) != at:
                if at is not None:
                    done.append((*at, digest.hexdigest()))
                at, digest = (depth, k0, k1), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
        if len(done) >= 10_000:
            yield _digests(done)
            done = []
    if at is not None:
        done.append((*at, digest.hexdigest()))
    yield _digests(done)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], names=["depth", "k0", "k1", "sha"]
    )


def prefix_nodes(turns: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of the trie over ``turns`` (conv, pos from 1, t0, t1, n_chars).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    A row with a null ``pos`` stands for a conversation without turns.
    """
    spark = turns.sparkSession
    with scratch():
        matrix = store(blocks(turns, width), "blocks").df
        shards = max(matrix.count() // shard_rows + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        # Members are part of the order, so copies of one conversation fill as many shards as they need.
        dealt = matrix.repartitionByRange(shards, "b", "p0", "p1", "ids", "more", "conv")
        rows = store(dealt.mapInArrow(_sort_shard, SORTED), "sorted").df
        borders = store(_borders(rows), "borders").df
        extra = borders.select(
            "shard", F.lit(-1).alias("place"), "first_shared", "last_shared", F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaf")
        ).unionByName(_later(rows, borders).select(
            "shard", "place", F.lit(-1).alias("first_shared"), F.lit(-1).alias("last_shared"), "saved", "leaf"
        ))
        nodes = store(rows.groupBy("shard").cogroup(extra.groupBy("shard")).applyInArrow(_nodes(width), NODES), "nodes").df
        found = store(_joined(nodes), "trie")
        found.keep()
    return found.df


def _joined(nodes: DataFrame) -> DataFrame:
    """Complete nodes as they are, the parts of the others added up, and the missing parents."""
    key = ["depth", "k0", "k1"]
    parts = nodes.where("open")
    texts = parts.where("ends IS NOT NULL").select(*key, "ends", "shard", "part")
    digests = (
        texts.repartition(*key).sortWithinPartitions(*key, "shard", "part").select(*key, "ends")
        .mapInArrow(_stream_ends, "depth long, k0 long, k1 long, sha string")
    )
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    whole = store(
        parts.groupBy(*key).agg(F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in sums])
        .join(digests, key, "left").withColumn("sha", F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256))), "whole"
    ).df
    # A parent's name is looked up by the shard of its children too: no key is larger than a shard.
    seen = parts.select("shard", *key).distinct()
    names = seen.join(whole.select(*key, F.col("conv").alias("found")), key).select(
        F.col("shard"), F.col("depth").alias("at"), F.col("k0").alias("q0"), F.col("k1").alias("q1"), "found"
    )
    one_part = parts.where("part = 0 AND conv IS NOT NULL").select(
        *key, "shard", "q0", "q1", "parent_open", "parent_conv"
    )
    # Every part of a node has the same parent; the first shard with a part looks it up.
    own = one_part.groupBy(*key).agg(F.min_by(F.struct("shard", "q0", "q1", "parent_open", "parent_conv"), "shard").alias("p"))
    mended = whole.join(own, key).select(*key, "conv", *sums, "sha", "p.*")
    closed = nodes.where("NOT open").select(*key, "conv", *sums, "sha", "shard", "q0", "q1", "parent_open", "parent_conv")
    every = closed.unionByName(mended)
    known = every.where("NOT parent_open")
    asked = every.where("parent_open").withColumn("at", F.col("depth") - 1).join(names, ["shard", "at", "q0", "q1"], "left")
    columns = ["conv", "depth", "parent", *sums, "sha"]
    both = known.withColumn("parent", F.col("parent_conv")).select(*columns).unionByName(
        asked.withColumn("parent", F.col("found")).select(*columns)
    )
    return both.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), *sums, F.col("sha").alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The trie of the conversations as they are, each with its own turns."""
    return prefix_nodes(numbered_turns(conversations), width, shard_rows)


def rebuilt_trie(conversations: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The trie of the conversations after each took its first turns from its host."""
    with scratch():
        found = prefix_nodes(rebuilt_turns(conversations), width, shard_rows)
    return found
