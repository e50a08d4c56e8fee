"""Vector codes, Hilbert shards and the conversation trie against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import SF, diff
from plain import ordered
from pyspark.sql import functions as F

from sigloom.llm import convtrie, hilbert, vectorcodes
from sigloom.llm.queries import QUERIES, SQL

VECTORS = "vec_id long, embedding array<float>, label int, code string, id long, q int"


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert diff(QUERIES[name](spark, SF), con, SQL[name]) == ""


# --- vector codes -----------------------------------------------------------------------------
def plain_codes(rows, entries=64, rounds=2, parts=16):
    """(vec_id, code, error, label_error, digest) by comparing each part with each entry."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab, *_ in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for length in {len(v) for _, v, _ in kept}:
        mine = [(i, v + [0] * (max(1, -(-length // parts)) * parts - length), lab) for i, v, lab in kept if len(v) == length]
        w = len(mine[0][1]) // parts
        cut = [[tuple(v[p * w:p * w + w]) for p in range(parts)] for _, v, _ in mine]
        named = [k for k in range(len(mine)) if mine[k][0] is not None] or list(range(len(mine)))
        first = sorted(named, key=lambda k: (mine[k][0] is None, mine[k][0] or 0, mine[k][1]))[:entries]
        books = [[cut[k][p] for k in first] for p in range(parts)]

        def nearest(p, q):
            return min((sum((a - b) ** 2 for a, b in zip(q, e)), k) for k, e in enumerate(books[p]))

        for _ in range(rounds):
            for p in range(parts):
                group = defaultdict(list)
                for c in cut:
                    group[nearest(p, c[p])[1]].append(c[p])
                for k, qs in group.items():
                    books[p][k] = tuple(sum(x) // len(qs) for x in zip(*qs))
        digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for (i, _, lab), c in zip(mine, cut):
            best = [nearest(p, c[p]) for p in range(parts)]
            out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), lab, digest))
    total = defaultdict(int)
    for r in out:
        total[r[3]] += r[2]
    return [(i, c, e, total[lab], g) for i, c, e, lab, g in out]


def vector_rows():
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(32)], i % 3 or None, "x", 1, 2) for i in range(150)]
    rows += [(7, rows[7][1], 1, "x", 1, 2)] * 40  # one vector in many rows
    rows += [(7, [0.0] * 32, 1, "x", 1, 2), (None, [0.5] * 32, None, None, None, None), (900, [1000.25, -4000.5] * 16, 2, "x", 1, 2)]
    rows += [(901, None, 1, "x", 1, 2), (902, [None] * 32, 1, "x", 1, 2), (903, [float("nan")] * 32, 1, "x", 1, 2),
             (904, [float("inf")] * 32, 1, "x", 1, 2), (905, [0.25] * 20, 1, "x", 1, 2), (906, [], 1, "x", 1, 2), (907, [0.5] * 20, 1, "x", 1, 2)]
    rng.shuffle(rows)
    return [(i, v and [None if x is None else float(np.float32(x)) for x in v], *r) for i, v, *r in rows]


def test_codes_of_hard_rows(spark):
    rows = vector_rows()
    got = vectorcodes.compressed(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert ordered(got.collect()) == ordered(plain_codes(rows))
    assert vectorcodes.compressed(spark.createDataFrame([], VECTORS)).count() == 0


def test_huge_components_are_held(spark):
    df = spark.createDataFrame([(1, [3e38] * 16, 1, "", 0, 0), (2, [-3e38] * 16, 1, "", 0, 0)], VECTORS)
    assert [r["error"] for r in vectorcodes.compressed(df, entries=1).orderBy("vec_id").collect()][0] > 0


def test_trie_sums_equal_direct_ones_in_any_run_length():
    rng = np.random.default_rng(2)
    parts = np.unique(rng.integers(-3, 4, (400, 5)), axis=0)
    entries = rng.integers(-3, 4, (9, 5))
    want = ((parts[:, None] - entries[None]) ** 2).sum(2)
    for leaves in (1, 7, 100, 5000):
        got = np.vstack([d for _, d in vectorcodes.trie_runs(parts, entries, leaves)])
        assert (got == want).all()


def test_decoded_vectors_are_near(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    whole = vectorcodes.whole_numbers(e)
    books = vectorcodes.fit_codebooks(whole)
    back = vectorcodes.decoded(vectorcodes.encoded(whole, books), books)
    j = back.join(e, F.col("id") == F.col("vec_id")).select("vector", "embedding", "error").collect()
    for r in j:
        d = ((np.floor(256 * np.array(r["embedding"])) - 256 * np.array(r["vector"])) ** 2).sum()
        assert round(d) == r["error"]
    assert np.mean([((np.array(r["vector"]) - r["embedding"]) ** 2).sum() for r in j]) < 0.5


def test_many_labels_meet_their_rows_salted(spark, monkeypatch):
    monkeypatch.setattr(vectorcodes, "broadcast_if_small", lambda df: df)
    rows = vector_rows()
    assert ordered(vectorcodes.compressed(spark.createDataFrame(rows, VECTORS)).collect()) == ordered(plain_codes(rows))


# --- Hilbert shards ---------------------------------------------------------------------------
@pytest.mark.parametrize("n, bits", [(1, 4), (2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(spark, n, bits):
    cells = list(itertools.product(range(1 << bits), repeat=n))
    names = [f"c{k}" for k in range(n)]
    got = spark.createDataFrame(cells, names).select(*names, hilbert.hilbert_index([F.col(c) for c in names], bits).alias("h")).collect()
    got = sorted(got, key=lambda r: r["h"])
    assert [r["h"] for r in got] == list(range(len(cells)))
    assert all(sum(abs(a[k] - b[k]) for k in range(n)) == 1 for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_of_hard_rows(spark, hard, hard_rows, nothing, law):
    rows = hard_rows + [(55, "same text", "en", "hot", 9)] * 300
    docs = spark.createDataFrame(rows, hard.schema).repartition(5).withColumns({"shard": F.lit("a"), "size": F.lit("b"), "_n": F.lit(0)})
    got = hilbert.plan(docs, law=law).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted(
        (d is None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(8)) and all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in order] == sorted(r["curve"] for r in got)
    if law == "rows":
        assert {len(v) for v in by.values()} <= {len(rows) // 8, len(rows) // 8 + 1}
    else:
        total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
        assert all(abs(sum(r["size"] for r in by[k]) - total / 8) <= most for k in range(8))
    assert hilbert.plan(nothing, law=law).count() == 0
    whole = hilbert.sharded(docs.drop("size"), law=law)
    assert whole.count() == len(rows) and whole.columns == ["doc_id", "text", "lang", "source", "n_chars", "_n", "shard", "slot", "curve"]


def test_runs_that_a_filter_leaves(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    dims = ("source", "lang", "n_chars")
    hilbert.write_shards(hilbert.sharded(docs, dims, shards=32), f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == docs.count()
    ranges = hilbert.run_ranges(back, dims)
    for d, low, high in (("n_chars", 0, 300), ("lang", "de", "de"), ("n_chars", 4000, 9000)):
        left = {r["shard"] for r in hilbert.runs_for(ranges, {d: (low, high)}).collect()}
        hold = {r["shard"] for r in back.where(F.col(d).between(low, high)).select("shard").distinct().collect()}
        assert hold <= left and len(left) < 24
    with pytest.raises(ValueError):
        hilbert.plan(docs, law="none")


# --- conversation trie ------------------------------------------------------------------------
def plain_trie(rows):
    conv = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            d = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            conv[c].append((t is not None, t or 0, d, role or "", text or ""))
    conv = {c: [x[3:] for x in sorted(v)] for c, v in conv.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in conv}
    seqs = {c: conv.get(c - c % 5, [])[:h[c]] + s[h[c]:] for c, s in conv.items()}
    members, kids = defaultdict(list), defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
            if d:
                kids[tuple(s[:d - 1])].add(tuple(s[:d]))
    leaves, saves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saves[p] = sum(saves[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saves[p],
             hashlib.sha256(",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p)).encode()).hexdigest())
            for p, m in members.items()]


def turn_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(120):
        n = rng.choice([1, 2, 3, 9, 12, 30])
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", None, ""])) for t in range(n)]
    rows += [(200 + c, t, "user", "same") for c in range(150) for t in range(10)]  # one conversation in many copies
    rows += [(None, 1, "user", "x"), (7, None, "user", "first"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "user", "other")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_turns", [40, 700, 1 << 18])
def test_trie_of_hard_rows(spark, block_turns):
    rows = turn_rows(block_turns)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"seq": F.lit(1), "key": F.lit("k"), "pos": F.lit(0)})
    got = convtrie.trie(convtrie.relinked(convtrie.sequences(turns.repartition(4))), block_turns)
    assert ordered(got.collect()) == ordered(plain_trie(rows))


def test_trie_of_nothing_and_of_one_turnless_conversation(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert convtrie.trie(convtrie.relinked(convtrie.sequences(none))).count() == 0
    # conversation 1 takes all of its turns from conversation 0, which does not exist
    one = spark.createDataFrame([(1, 0, "user", "x")], none.schema)
    assert ordered(convtrie.trie(convtrie.relinked(convtrie.sequences(one))).collect()) == ordered(plain_trie([(1, 0, "user", "x")]))


def test_range_minima():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 64, 100):
        v = rng.integers(-1, 6, n)
        t = convtrie.Minima(v)
        at, least = rng.integers(0, n, 200), rng.integers(-1, 7, 200)
        right, left = t.right(at, least), t.left(at, least)
        for a, d, r, lo in zip(at, least, right, left):
            below = np.flatnonzero(v < d)
            assert r == min(below[below >= a], default=n) and lo == max(below[below <= a], default=-1)
