"""Prefix trie of conversations from sorted common prefixes and sparse tables of range minima.

A node is a distinct sequence of first turns, and the conversations that start with it are its members. Distinct
conversations are sorted, so the members of a node are an interval of them: it ends on either side where the common
prefix (LCP) of two neighbours is shorter than the node is deep. A sparse table holds the least LCP of every run of
2^k neighbours, and each candidate prefix finds its two ends by binary search in it, independently of all others and
without a stack. Running totals over the sorted conversations then give members, leaves and saved tokens of an
interval, a second sparse table its smallest member.

Sorted conversations are cut into blocks of about BLOCK_TURNS turns, each with sparse tables of its own. A third one
over the least LCP of each block (one number a block) tells in which block the prefixes start that a block only
continues. Each block sums its share of such a prefix, and the shares meet in a partial aggregation. A prefix that a
third of all conversations share is thus cut over all blocks that it spans. The tree of prefixes that cross a block's
end (a row for each block end and depth, no matter how many conversations) is added up in one task.

Turns are compared by a 128-bit digest of role and text; texts are read once and not shuffled. A conversation's digests
and text sizes (20 bytes a turn) must fit into one row. Ids of equal conversations are hashed as a sorted stream, in
constant memory; SHA-256 cannot be cut, so one task reads the ids of a group of equal conversations.

Defined cases: turns without a conversation id are dropped; a null turn number is first, equal ones are in order of
their digests, and rows that repeat are turns of their own; a null role or text is empty; a conversation without turns
is a member of the root. Extra columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigloom.llm.common import column, saved
from sigloom.session import broadcast_if_small

BLOCK_TURNS = 1 << 18
ROW_MASK = (1 << 33) - 1
NODE, STARTS, CONTINUES = 0, 1, 2
NO_IDS = hashlib.sha256(b"").hexdigest()
PARTS = ("kind int, block int, pos int, depth int, parent_block int, conv_id long, parent_conv_id long, n_convs long, "
         "n_children long, n_leaves long, saved_tokens long, last_bytes long, end_block int, end_pos int, ends string")
OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id and seq, the digests and text sizes of a conversation's turns in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    own = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("t"), digest.alias("d"), F.octet_length(text).alias("n")).alias("s"))
    return own.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("s")).select(
        "conv_id", F.transform("s", lambda s: F.struct(s["d"].alias("d"), s["n"].alias("n"))).alias("seq"))


def relinked(convs: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % group; h is crc32(c) % most.

    There are as many taken turns as that conversation has, none if it does not exist; c's turns after its first h follow.
    """
    c = F.col("conv_id")
    heads = convs.where(c % group == 0).select(c.alias("_b"), F.slice("seq", 1, most - 1).alias("_head"))
    h = (F.crc32(c.cast("string").cast("binary")) % most).cast("int")
    seq = F.concat(F.slice(F.coalesce("_head", F.slice("seq", 1, 0)), F.lit(1), h), F.slice("seq", h + 1, F.size("seq")))
    return convs.join(heads, F.col("_b") == c - c % group, "left").select("conv_id", seq.alias("seq"))


def grouped(convs: DataFrame) -> DataFrame:
    """The distinct sequences, each with its number of conversations, the smallest id and the digest of all ids."""
    key = F.unhex(F.md5(F.array_join(F.transform("seq", lambda s: F.hex(s["d"])), "").cast("binary")))
    keyed = convs.withColumn("key", key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by key and id: the state of one group is all that is held
        key, n, least, digest, done = None, 0, 0, None, []

        def rows():
            names = ("key", "n", "least", "ends")
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(
                zip(*done), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=list(names))

        for b in batches:
            ids = column(b, "conv_id").to_pylist()
            keys = column(b, "key").to_pylist()
            at = 0
            while at < len(ids):
                end = at + 1
                while end < len(ids) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != key:
                    if key is not None:
                        done.append((key, n, least, digest.hexdigest()))
                    key, n, least, digest = keys[at], 0, ids[at], hashlib.sha256()
                text = ",".join(map(str, ids[at:end]))
                digest.update(("," + text if n else text).encode())
                n, at = n + end - at, end
            if len(done) > 10000:
                yield rows()
                done = []
        if key is not None:
            done.append((key, n, least, digest.hexdigest()))
        if done:
            yield rows()

    stats = keyed.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(
        run, "key binary, n long, least long, ends string")
    return keyed.groupBy("key").agg(F.first("seq").alias("seq")).join(stats, "key").drop("key")


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that two different sequences share."""
    same = F.zip_with(a, b, lambda x, y: x["d"].eqNullSafe(y["d"]))
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def sorted_blocks(distinct: DataFrame, block_turns: int) -> DataFrame:
    """block, pos, lcp (with the sequence before, -1 for the very first), sizes, n, least and ends of sorted sequences."""
    turns = distinct.agg(F.sum(F.size("seq"))).first()[0] or 0
    blocks = max(1, math.ceil(turns / block_turns))
    s = distinct.repartitionByRange(blocks, "seq").sortWithinPartitions("seq").select(
        F.spark_partition_id().alias("block"), F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_MASK)).cast("int").alias("pos"), "*")
    s = saved(s)
    edges = s.groupBy("block").agg(F.min_by("seq", "pos").alias("first"), F.max_by("seq", "pos").alias("last"))
    before = F.lag("last").over(Window.orderBy("block"))  # one row a block
    edges = edges.select(F.col("block").alias("_b"), F.when(before.isNull(), -1).otherwise(common_prefix(before, F.col("first"))).alias("_lcp"))
    inside = common_prefix(F.lag("seq").over(Window.partitionBy("block").orderBy("pos")), F.col("seq"))
    s = s.withColumn("lcp", inside).join(broadcast_if_small(edges), F.col("block") == F.col("_b"))
    return saved(s.select("block", "pos", F.when(F.col("pos") == 0, F.col("_lcp")).otherwise(F.col("lcp")).alias("lcp"),
                          F.transform("seq", lambda x: x["n"]).alias("sizes"), "n", "least", "ends"))


class Minima:
    """Sparse table of range minima."""

    def __init__(self, v: np.ndarray):
        self.rows = [v]
        while 2 << (len(self.rows) - 1) <= len(v):
            a, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(a[:-half], a[half:]))

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """First place from ``at`` on whose value is below ``least``, the length where there is none."""
        at = at.copy()
        for k in reversed(range(len(self.rows))):
            row = self.rows[k]
            fits = at < len(row)
            fits[fits] = row[at[fits]] >= least[fits]
            at += fits.astype(np.int64) << k
        return at

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Last place up to ``at`` whose value is below ``least``, -1 where there is none."""
        at = at.copy()
        for k in reversed(range(len(self.rows))):
            start = at - (1 << k) + 1
            fits = start >= 0
            fits[fits] = self.rows[k][start[fits]] >= least[fits]
            at -= fits.astype(np.int64) << k
        return at

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum of each [a, b), none of them empty."""
        k = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), self.rows[0].dtype)
        for level in np.unique(k).tolist():
            s = k == level
            out[s] = np.minimum(self.rows[level][a[s]], self.rows[level][b[s] - (1 << level)])
        return out


def _totals(v: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(v, dtype=np.int64)])


def block_nodes(block: int, lows: np.ndarray, heads: np.ndarray, lcp, sizes, ends_at, n, least, ends) -> dict:
    """All nodes that start in one block, and its shares of those that start before it.

    ``lows`` and ``heads`` hold the least and the first LCP of every block; ``sizes`` are the text sizes of all turns,
    cut at ``ends_at``.
    """
    m = len(lcp)
    after = int(heads[block + 1]) if block + 1 < len(heads) else -1
    length = np.diff(ends_at)
    table, ids, above = Minima(lcp), Minima(least), Minima(lows)
    leaf = np.append(lcp[1:], after) < length
    # candidates of a sequence: the prefixes that the sequence before it does not have
    fresh = length - lcp
    first = _totals(fresh)
    j = np.repeat(np.arange(m), fresh)
    depth = np.arange(first[-1]) - first[j] + lcp[j] + 1
    end = table.right(j + 1, depth)
    crosses = (end == m) & (after >= depth)
    # the candidate that is one turn shorter
    up = table.left(j, depth - 1)
    inside = (up >= 0) & (depth > 0)
    parent = np.where(inside, first[np.maximum(up, 0)] + depth - 1 - (lcp[np.maximum(up, 0)] + 1), 0)
    outside = ~inside & (depth > 0)
    parent_block = np.full(len(j), -1)
    parent_block[inside & crosses[parent]] = block
    parent_block[outside] = above.left(np.full(int(outside.sum()), block - 1), depth[outside] - 1)
    convs, leaves = _totals(n), _totals(leaf)
    members = convs[end] - convs[j]
    size = np.zeros(len(j), np.int64)
    size[depth > 0] = sizes[(ends_at[j] + depth - 1)[depth > 0]]
    saves = _totals(np.where(crosses, 0, (members - 1) * size))
    smallest = ids.least(j, end)
    whole = {
        "kind": np.where(crosses, STARTS, NODE), "block": np.full(len(j), block), "pos": j, "depth": depth,
        "parent_block": parent_block, "conv_id": smallest, "n_convs": members,
        "parent_conv_id": pa.array(smallest[parent], mask=~inside | (parent_block >= 0)),
        "n_children": np.bincount(parent[inside], minlength=len(j)), "n_leaves": leaves[end] - leaves[j],
        "saved_tokens": saves[first[end]] - saves[np.arange(len(j))], "last_bytes": size,
        "end_block": np.full(len(j), block), "end_pos": end,
        "ends": pa.array(np.where(depth == length[j], ends[j], NO_IDS).astype(object), pa.string())}
    # prefixes that come from the block before
    d = np.arange(max(0, int(lcp[0]) + 1))
    reach = table.right(np.zeros(len(d), np.int64), d)
    share = {
        "kind": np.full(len(d), CONTINUES), "block": above.left(np.full(len(d), block - 1), d), "pos": np.full(len(d), -1), "depth": d,
        "parent_block": np.full(len(d), -1), "conv_id": ids.least(np.zeros(len(d), np.int64), reach), "n_convs": convs[reach],
        "parent_conv_id": pa.nulls(len(d), pa.int64()),
        "n_children": np.bincount(depth[outside] - 1, minlength=len(d))[:len(d)], "n_leaves": leaves[reach],
        "saved_tokens": saves[first[reach]], "last_bytes": np.zeros(len(d), np.int64),
        "end_block": np.full(len(d), block), "end_pos": reach, "ends": pa.nulls(len(d), pa.string())}
    return {k: pa.concat_arrays([pa.array(whole[k]), pa.array(share[k])]) for k in whole}


def _crossing(table: pa.Table) -> pa.Table:
    """Saved tokens and parents of the prefixes that cross a block's end; one row for each block end and depth."""
    t = table.sort_by([("block", "ascending"), ("pos", "ascending"), ("depth", "ascending")])
    v = {k: t.column(k).to_numpy(zero_copy_only=False) for k in ("block", "pos", "depth", "parent_block", "conv_id", "n_convs",
                                                               "saved_tokens", "last_bytes", "end_block", "end_pos")}
    own = _totals((v["n_convs"] - 1) * v["last_bytes"])
    place = v["block"].astype(np.int64) << 32 | v["pos"]
    last = np.searchsorted(place, v["end_block"].astype(np.int64) << 32 | v["end_pos"])
    total = v["saved_tokens"] + own[last] - own[:-1]
    ids = dict(zip(zip(v["block"].tolist(), v["depth"].tolist()), v["conv_id"].tolist()))
    up = [ids.get((b, d - 1)) for b, d in zip(v["parent_block"].tolist(), v["depth"].tolist())]
    for name, x in (("saved_tokens", total), ("parent_conv_id", pa.array(up, pa.int64()))):
        k = t.schema.get_field_index(name)
        t = t.set_column(k, name, pa.chunked_array([pa.array(x)]))
    return t


def trie(convs: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The nodes of the trie of ``convs`` (conv_id and seq, as ``sequences`` gives them)."""
    t = sorted_blocks(saved(grouped(convs)), block_turns)
    # blocks that hold rows are numbered anew from 0; four numbers each
    edges = t.groupBy("block").agg(F.min("lcp").alias("low"), F.min_by("lcp", "pos").alias("head")).orderBy("block").collect()
    number = {r["block"]: k for k, r in enumerate(edges)}
    lows, heads = np.array([r["low"] for r in edges], np.int64), np.array([r["head"] for r in edges], np.int64)

    def run(table: pa.Table) -> pa.Table:
        s = table.sort_by("pos").combine_chunks()
        sizes = s.column("sizes").chunk(0)
        v = {k: s.column(k).to_numpy(zero_copy_only=False) for k in ("lcp", "n", "least", "ends")}
        cut = np.frombuffer(sizes.buffers()[1], np.int32)[sizes.offset:sizes.offset + len(sizes) + 1].astype(np.int64)
        got = block_nodes(number[s.column("block")[0].as_py()], lows, heads, v["lcp"].astype(np.int64),
                          sizes.values.to_numpy(zero_copy_only=False).astype(np.int64), cut, v["n"], v["least"], v["ends"])
        ints = {"kind", "block", "pos", "depth", "parent_block", "end_block", "end_pos"}
        names = [c.split()[0] for c in PARTS.split(", ")]
        return pa.table({k: got[k].cast(pa.int32()) if k in ints else got[k] for k in names})

    parts = saved(t.groupBy("block").applyInArrow(run, PARTS))
    end = F.max(F.struct("end_block", "end_pos"))
    joined = parts.where(F.col("kind") != NODE).groupBy("block", "depth").agg(
        F.max("pos").alias("pos"), F.max("parent_block").alias("parent_block"), F.min("conv_id").alias("conv_id"),
        F.lit(None).cast("long").alias("parent_conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("last_bytes").alias("last_bytes"), end["end_block"].alias("end_block"), end["end_pos"].alias("end_pos"), F.max("ends").alias("ends"))
    crossing = saved(joined.groupBy().applyInArrow(_crossing, joined.schema))
    up = broadcast_if_small(crossing.select(F.col("block").alias("_b"), F.col("depth").alias("_d"), F.col("conv_id").alias("_up")))
    nodes = parts.where(F.col("kind") == NODE).join(up, (F.col("parent_block") == F.col("_b")) & (F.col("depth") - 1 == F.col("_d")), "left")
    nodes = nodes.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up"))
    both = nodes.withColumnRenamed("ends", "ends_sha256").select(*OUT).unionByName(crossing.withColumnRenamed("ends", "ends_sha256").select(*OUT))
    return both.select("conv_id", F.col("depth").cast("long").alias("depth"), *OUT[2:])
