"""N-gram Jaccard join over a prefix tree, and the classes of documents that its links connect.

Sets of distinct word n-grams are kept as tokens in one global order, rare ones first: a count sketch over the whole
corpus gives each token its frequency class, which leads the token. Two sets that reach the threshold share ``l``
tokens among their first ``n - ceil(t n) + l`` (the prefix), so candidates meet there. The work goes in two rounds,
so that no group of copies is expanded into pairs:

1. every document is compared with one hub, the document that shares most of its prefix tokens among the ones with
   the fewest tokens of their own (an original, in a group of edited copies);
2. what is not in one class yet is compared too: documents of one hub in blocks of them, without a row for a pair,
   all others where they share enough prefix tokens. Within a class the answer is known, so nothing is lost.

Comparing is a walk over a prefix tree: a block of sets, common tokens first, is stored as sorted paths where each
shares its beginning with the one before; a walk takes over the overlap counted for the shared part, and leaves a
subtree when the tokens missed so far cannot be made up by what remains. Equal sets are one node from the start.

Tokens are 48-bit (4 bits of class, 44 of the n-gram's hash) where sets are compared, 64-bit where they are counted.

Defined cases: a text with fewer than ``n_words`` words is one n-gram, without words (or null) it has an empty set and
links with nothing; rows that repeat are copies of each other; rows without a doc_id take part, and a class without any
doc_id has none. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import (LOWER, U64, column, discard, gram_hash, mix, prefix_hash, saved, small_batches, span_hash, text_blocks,
                                whole_groups, words_of)
from sigloom.llm.graph import components
from sigloom.session import broadcast_if_small

CLASS_SHIFT = 44
#: Buckets of the sketch, its rows, and how many partial sketches are summed into one at first.
SKETCH_BITS, CHUNKS, FAN_IN = 22, 64, 16
#: Members of one prefix-tree block, and parts of a hot token.
BLOCK, PARTS = 512, 16
#: Documents of one hub in a block; two blocks meet in one task.
HUB_BLOCK = 1024
#: One more shared prefix token is asked for with every so many n-grams.
PER_SHARED = 32
#: Pairs that a task holds before it sums them up.
HELD_PAIRS = 1 << 20


def _sets(texts: pa.Array, n_words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row, and the sorted distinct n-gram hashes of the texts that follow."""
    for first, off, raw in text_blocks(texts):
        buf = LOWER[raw]
        start, end, doc = words_of(buf, off)
        word = span_hash(prefix_hash(buf), start, end)
        gram = gram_hash(word, n_words)
        cut = np.searchsorted(doc, np.arange(len(off)))
        out = []
        for a, b in zip(cut.tolist(), cut[1:].tolist()):
            if b - a >= n_words:
                out.append(np.unique(gram[a:b - n_words + 1]))
            elif b > a:
                out.append(gram_hash(word[a:b], b - a))
            else:
                out.append(np.zeros(0, U64))
        yield first, out


def _sketch(docs: DataFrame, n_words: int) -> np.ndarray:
    """Frequency class of every hash bucket, counted over all documents; 2^SKETCH_BITS bytes whatever the corpus.

    Class 0 has the buckets within the noise of the usual load, each further class doubles the excess.
    """
    chunk = (1 << SKETCH_BITS) // CHUNKS
    schema = "chunk int, part int, seen binary"

    def batch_of(rows: list[tuple[int, int, np.ndarray]], kind: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "chunk": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([r[1] for r in rows], pa.int32()),
            "seen": pa.array([zlib.compress(kind.encode() + r[2].astype(kind).tobytes(), 1) for r in rows], pa.binary())})

    def counts(raw: bytes) -> np.ndarray:
        raw = zlib.decompress(raw)
        return np.frombuffer(raw, raw[:2].decode(), offset=2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SKETCH_BITS, np.uint16)
        for batch in batches:
            for _, sets in _sets(column(batch, "text"), n_words):
                at, n = np.unique((np.concatenate(sets) >> U64(64 - SKETCH_BITS)).astype(np.int64), return_counts=True)
                seen[at] = np.minimum(255, seen[at] + n)
        part = (TaskContext.get().partitionId() if TaskContext.get() else 0) // FAN_IN
        yield batch_of([(c, part, seen[c * chunk:(c + 1) * chunk]) for c in range(CHUNKS) if seen[c * chunk:(c + 1) * chunk].any()], "u1")

    def added(keys: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, total = None, None
            for batch in batches:
                for r in batch.to_pylist():
                    if key != [r[k] for k in keys]:
                        if key is not None:
                            yield batch_of([(key[0], key[-1], total)], "u4")
                        key, total = [r[k] for k in keys], np.zeros(chunk, np.uint32)
                    total += counts(r["seen"])
            if key is not None:
                yield batch_of([(key[0], key[-1], total)], "u4")

        return run

    rows = docs.select("text").mapInArrow(count, schema)
    for keys in (["chunk", "part"], ["chunk"]):
        rows = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(added(keys), schema)
    total = np.zeros(1 << SKETCH_BITS, np.float64)
    # one row for each of the CHUNKS
    for r in rows.select("chunk", "seen").collect():
        total[r["chunk"] * chunk:(r["chunk"] + 1) * chunk] = counts(r["seen"])
    usual = np.median(total)
    excess = (total - usual) / (6 * math.sqrt(usual) + 8)
    return np.where(excess > 1, np.minimum(15, 1 + np.log2(np.maximum(1, excess))), 0).astype(np.uint8)


def ngram_sets(docs: DataFrame, n_words: int = 5) -> DataFrame:
    """k (a key of the row), doc_id, n, fp (equal for equal sets) and toks (48-bit tokens in global order)."""
    kinds = small_batches(docs).sparkSession.sparkContext.broadcast(_sketch(docs, n_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for batch in batches:
            ids = column(batch, "doc_id")
            for first, sets in _sets(column(batch, "text"), n_words):
                flat = np.concatenate(sets)
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                kind = kinds.value[(flat >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(U64)
                # the low hash bits: the high ones chose the bucket
                tok = kind << U64(CLASS_SHIFT) | flat & U64((1 << CLASS_SHIFT) - 1)
                cut = np.concatenate([[0], np.cumsum(size)])
                print_ = np.concatenate([[0], np.cumsum(mix(flat))]).astype(U64)
                fp = mix(print_[cut[1:]] - print_[cut[:-1]]).view(np.int64)
                toks = [np.sort(tok[a:b]).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k + np.arange(len(sets))), ids.slice(first, len(sets)), pa.array(size.astype(np.int32)),
                     pa.array(fp), pa.array(toks, pa.binary())], names=["k", "doc_id", "n", "fp", "toks"])
                k += len(sets)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return saved(rows.mapInArrow(run, "k long, doc_id long, n int, fp long, toks binary"), "snappy")


def _tokens(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _prefix_rows(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                n = column(batch, "n").to_numpy().astype(np.int64)
                size = n - -(-percent * n // 100) + np.maximum(1, n // PER_SHARED) * (n > 0)
                toks = [_tokens(r[:6 * s]) for r, s in zip(column(batch, "toks").to_pylist(), size.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "tok": np.concatenate(toks).view(np.int64), "k": np.repeat(column(batch, "k").to_numpy(), size),
                    "n": np.repeat(n, size).astype(np.int32)})

    return run


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token and part: those whose token occurs again (or may, in another part)."""
    held, again = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [column(batch, c).to_numpy() for c in ("tok", "part", "k", "n")]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        same = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])
        keep = np.zeros(len(cols[0]), bool)
        keep[0] = again
        keep[1:] |= same
        keep[:-1] |= same
        keep |= cols[0] >> CLASS_SHIFT > 0
        held, again = [c[-1:] for c in cols], bool(keep[-1])
        keep[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(cols[i][keep]) for i in (0, 2, 3)], names=["tok", "k", "n"])
    if again:
        yield pa.RecordBatch.from_arrays([pa.array(held[i]) for i in (0, 2, 3)], names=["tok", "k", "n"])


def tree_overlaps(probe: np.ndarray, members: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible overlap of ``probe`` with each member (sorted token arrays).

    Both are the overlap itself where the walk came to the end; where it was cut short there is no link.
    """
    low, high = np.zeros(len(members), np.int64), np.zeros(len(members), np.int64)
    down = [m[::-1] for m in members]  # common tokens first
    order = sorted(range(len(down)), key=lambda i: down[i].astype(">u8").tobytes())
    big = max(map(len, members))

    def needed(n: int) -> int:
        """Tokens that a set of n must share with the probe."""
        return -(-percent * (n + len(probe)) // (100 + percent))

    spare, least = max(big - needed(big), 0), needed(min(map(len, members)))
    none = 1 << 60
    dead, got, left, last, counted = none, 0, 0, down[order[0]][:0], np.zeros(0, np.int64)
    for i in order:
        path = down[i]
        m = min(len(last), len(path))
        differ = np.flatnonzero(last[:m] != path[:m])
        shared = int(differ[0]) if len(differ) else m
        last = path
        if shared < dead:
            dead = none
            counted = counted[:shared]
            while len(counted) < len(path):
                part = path[len(counted):len(counted) + 128]
                at = np.searchsorted(probe, part)
                hit = probe[np.minimum(at, len(probe) - 1)] == part
                counted = np.concatenate([counted, (counted[-1] if len(counted) else 0) + np.cumsum(hit)])
                depth, got, left = len(counted), int(counted[-1]), int(at[-1])
                if depth < len(path) and (depth - got > spare or got + min(left, big - depth) < least):
                    dead = depth
                    break
            if dead == none:
                low[i] = high[i] = int(counted[-1]) if len(counted) else 0
                continue
        # below a node that was left
        low[i], high[i] = got, got + min(left, len(path) - dead)
    return low, high


def _compared(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["a", "part"]):
            a, part, b = (table.column(c).to_numpy() for c in ("a", "part", "b"))
            toks = table.column("toks").to_pylist()
            cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (part[1:] != part[:-1]), [True]])).tolist()
            out = []
            for x, y in zip(cut, cut[1:]):
                sets = {int(b[i]): _tokens(toks[i]) for i in range(x, y)}
                probe = sets.pop(int(a[x]))
                names = [k for k, s in sets.items() if 100 * min(len(s), len(probe)) >= percent * max(len(s), len(probe))]
                if not names:
                    continue
                low, high = tree_overlaps(probe, [sets[k] for k in names], percent)
                size = np.array([len(sets[k]) for k in names])
                out.append((np.full(len(names), a[x]), np.array(names, np.int64), low, high,
                            (low == high) & (100 * low >= percent * (len(probe) + size - low))))
            cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", "low", "high", "linked"])

    return run


def _walked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with the bounds of their overlap (low, high) and whether they are linked; a is the probe."""
    pairs = saved(pairs.select("a", "b"))
    ids = pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).distinct()
    need = saved(sets.select("k", "toks").join(broadcast_if_small(ids), "k"), "snappy")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    members = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    probes = parts.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = members.unionByName(probes).join(need.withColumnRenamed("k", "b"), "b")
    dealt = rows.repartition("a", "part").sortWithinPartitions("a", "part")
    out = saved(dealt.select("a", "part", "b", "toks").mapInArrow(
        _compared(percent), "a long, b long, low long, high long, linked boolean"))
    discard(need, pairs)
    return out


def _hub_links(percent: int):
    """Links (u, v) between documents of one hub in different classes, of two blocks (i, j) of them.

    Two sets that were compared with the same hub bound their own overlap: |x & m| <= |x & hub| + |m - hub|. Pairs
    whose bound stays below the threshold are left out. Probes are the documents of small classes.
    """
    def links(part, i, j, k, n, root, low, high, toks) -> Iterator[tuple[int, int]]:
        _, at, size = np.unique(root, return_inverse=True, return_counts=True)
        if len(size) < 2:
            return
        order = np.lexsort((root, size[at]))
        part, k, n, root, low, high = (x[order] for x in (part, k, n, root, low, high))
        sets = [_tokens(toks[r]) for r in order.tolist()]
        for a in range(len(k) - 1):
            b = np.arange(a + 1, len(k))
            most = np.minimum(high[a] + n[b] - low[b], high[b] + n[a] - low[a])
            most = np.minimum(most, np.minimum(n[a], n[b]))
            b = b[(root[b] != root[a]) & ((part[b] != part[a]) | (i == j)) & (100 * most >= percent * (n[a] + n[b] - most))]
            if len(b):
                least, most = tree_overlaps(sets[a], [sets[m] for m in b.tolist()], percent)
                for m in b[(least == most) & (100 * least >= percent * (n[a] + n[b] - least))].tolist():
                    yield int(k[a]), int(k[m])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["hub", "i", "j"]):
            hub, i, j, *cols = (table.column(c).to_numpy().astype(np.int64) for c in ("hub", "i", "j", "part", "k", "n", "root", "low", "high"))
            toks = table.column("toks").to_pylist()
            new = (hub[1:] != hub[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            cut = np.flatnonzero(np.concatenate([[True], new, [True]])).tolist()
            found = [p for x, y in zip(cut, cut[1:]) for p in links(cols[0][x:y], i[x], j[x], *(c[x:y] for c in cols[1:]), toks[x:y])]
            yield pa.RecordBatch.from_pydict({"u": pa.array([p[0] for p in found], pa.int64()), "v": pa.array([p[1] for p in found], pa.int64())})

    return run


def _linked_by_hub(known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between documents of the same hub in different classes. ``known``: k, n, root, hub, low and high."""
    mixed = known.groupBy("hub").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.ceil(F.count("*") / HUB_BLOCK).cast("int").alias("parts"))
    asked = broadcast_if_small(known.join(mixed.where("x <> y").drop("x", "y"), "hub"))
    rows = sets.select("k", "toks").join(asked, "k").withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other", "parts")
    dealt = rows.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    return saved(dealt.mapInArrow(_hub_links(percent), "u long, v long"))


def _open_pairs(percent: int):
    """Pairs of one token's rows in different classes and with different hubs that may be linked, with how many tokens they met at.

    A set and its own hub are left out, they were compared.
    """
    def summed(parts: list) -> pa.RecordBatch:
        x, y, c = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((y, x))
        x, y, c = x[order], y[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        return pa.RecordBatch.from_pydict({"a": x[first], "b": y[first], "c": np.add.reduceat(c, first)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for table in whole_groups(batches, ["tok"]):
            tok, k, n, root, hub = (table.column(c).to_numpy().astype(np.int64) for c in ("tok", "k", "n", "root", "hub"))
            end = np.searchsorted(tok, tok, "right")
            step, open_ = 0, np.arange(len(tok))
            while len(open_):
                # every row with the one ``step`` places on in its token's run; sizes ascend
                step += 1
                open_ = open_[open_ + step < end[open_]]
                open_ = open_[percent * n[open_ + step] <= 100 * n[open_]]
                i = open_[root[open_] != root[open_ + step]]
                j = i + step
                done = (hub[i] == hub[j]) & (hub[i] >= 0) | (hub[i] == k[j]) | (hub[j] == k[i])
                i, j = i[~done], j[~done]
                if len(i):
                    held.append((np.minimum(k[i], k[j]), np.maximum(k[i], k[j]), np.ones(len(i), np.int64)))
                    n_held += len(i)
                if n_held > HELD_PAIRS:
                    yield summed(held)
                    held, n_held = [], 0
        if held:
            yield summed(held)

    return run


def classes(docs: DataFrame, n_words: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row."""
    sets = ngram_sets(docs, n_words)
    heads = saved(sets.drop("toks"))
    reps = saved(heads.where("n > 0").groupBy("n", "fp").agg(F.min("k").alias("rep")))
    part = F.when(F.shiftright("tok", CLASS_SHIFT) > 0, F.pmod(F.xxhash64("k"), F.lit(PARTS))).otherwise(0).cast("int")
    rows = sets.select("k", "n", "toks").mapInArrow(_prefix_rows(percent), "tok long, k long, n int")
    shared = saved(rows.withColumn("part", part).repartition("tok", "part").sortWithinPartitions("tok", "part").mapInArrow(
        _shared_rows, "tok long, k long, n int"))
    # one row of each set, of documents that share enough; then tokens that still occur twice, and again
    enough = F.greatest(F.lit(1), F.floor(F.floor(F.col("n") * percent / 100) / PER_SHARED))
    able = shared.groupBy("k", "n").agg(F.count("*").alias("c")).where(F.col("c") >= enough).select("k").join(
        reps.select(F.col("rep").alias("k")), "k")
    every, shared = shared, saved(shared.join(able, "k"))
    discard(every)
    several = shared.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1").select("tok")
    every, shared = shared, saved(shared.join(several, "tok"))
    discard(every)
    live = shared.groupBy("k", "n").agg(F.count("*").alias("c")).where(F.col("c") >= enough).select(
        "k", "n", (F.col("n") - F.ceil(F.col("n") * percent / 100) + F.greatest(F.lit(1), F.floor(F.col("n") / PER_SHARED))
              - F.col("c")).alias("own"))
    live = saved(live)
    every, shared = shared, saved(shared.join(live.select("k", "own"), "k"))
    discard(every)
    # round 1: each document with its hub
    hubs = shared.groupBy("tok").agg(F.min(F.struct("own", F.col("k").alias("hub"))).alias("h"))
    with_hub = shared.select("tok", "k").join(hubs, "tok").where("k <> h.hub").groupBy("k", "h.hub").agg(F.count("*").alias("c"))
    first = with_hub.groupBy("k").agg(F.max(F.struct("c", "hub")).alias("best")).select(
        F.col("best.hub").alias("a"), F.col("k").alias("b"))
    walked = _walked(first, sets, percent)
    links = walked.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    # round 2: what shares enough, is not known to be connected and may be linked
    roots = components(links)
    own = walked.select(F.col("b").alias("k"), F.col("a").alias("hub"), "low", "high").join(live.select("k", "n"), "k")
    own = saved(own.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k")))
    links = links.unionByName(_linked_by_hub(own, sets, percent))
    roots = components(links)
    rest = shared.select("tok", "k", "n").join(roots.withColumnRenamed("node", "k"), "k", "left").join(own.select("k", "hub"), "k", "left").select(
        "tok", "k", "n", F.coalesce("root", "k").alias("root"), F.coalesce("hub", F.lit(-1)).alias("hub"))
    rest = saved(rest)
    discard(shared)
    several = rest.groupBy("tok").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("tok")
    runs = rest.join(several, "tok").repartition("tok").sortWithinPartitions("tok", "n")
    size = live.select("k", "n")
    second = runs.mapInArrow(_open_pairs(percent), "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))
    second = second.join(size.withColumnsRenamed({"k": "a", "n": "na"}), "a").join(size.withColumnsRenamed({"k": "b", "n": "nb"}), "b")
    second = second.where(F.col("c") >= F.greatest(F.lit(1), F.floor(F.least("na", "nb") / PER_SHARED)))
    more = _walked(second, sets, percent).where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    discard(rest, sets)
    roots = components(links.unionByName(more))
    node = heads.where("n > 0").join(reps, ["n", "fp"]).join(
        roots.withColumnRenamed("node", "rep"), "rep", "left").select("k", "doc_id", F.coalesce("root", "rep").alias("root"))
    node = saved(node)
    named = node.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    known = node.join(named, "root").select("k", "component_id")
    return heads.select("k", "doc_id", "n").join(known, "k", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n_words: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with the smallest doc_id of each class only, and once each; columns as they are.

    Rows without a doc_id stay, one of each text.
    """
    found = classes(docs, n_words, percent)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_at"),
                       F.xxhash64("text").alias("_hash"))
    rows = rows.join(kept, F.col("_at") == F.col("_id")).drop("_id").unionByName(rows.where("_at is null"))
    return rows.dropDuplicates(["_at", "_hash"]).select("_row.*")
