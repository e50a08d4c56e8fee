"""N-gram join, repeated passages, mixing, token output, pieces, nearest neighbours, and the pipeline."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from plain import cut_repeats, jaccard_classes, ordered, waterfill
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sigloom.llm import ann, graph, mixing, ngramjoin, sentencepieces, suffixdedup, tokenout
from sigloom.llm.eliasfano import EliasFano

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_classes(hard, hard_rows, nothing):
    got = ngramjoin.classes(hard.withColumn("k", F.lit(1))).collect()
    assert ordered(got) == ordered(jaccard_classes([r[:2] for r in hard_rows]))
    assert ngramjoin.classes(nothing).count() == 0


def test_classes_of_edited_copies(spark):
    """A hundred edited copies of one text, chains of edits, and a passage that all others share."""
    rnd = random.Random(4)
    base, passage = [f"w{rnd.randrange(400)}" for _ in range(150)], [f"p{i}" for i in range(40)]
    rows = []
    for i in range(100):
        w = list(base)
        for _ in range(rnd.randrange(9)):
            w[rnd.randrange(150)] = f"e{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    for i in range(60):
        rows.append((200 + i, " ".join(passage + [f"u{rnd.randrange(10**6)}" for _ in range(rnd.randrange(5, 60))])))
    w = list(base)
    for i in range(30):
        w[5 * i] = f"c{i}"
        rows.append((300 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ordered(ngramjoin.classes(df).collect()) == ordered(jaccard_classes(rows))


def test_tree_overlaps_are_exact_where_not_cut():
    rnd = np.random.default_rng(2)
    probe = np.unique(rnd.integers(0, 3000, 400).astype(np.uint64))
    members = []
    for k in (0, 5, 20, 60, 200):
        gone = rnd.permutation(probe)[k:]
        members.append(np.unique(np.concatenate([gone, rnd.integers(0, 3000, k).astype(np.uint64)])))
    for m, low, high in zip(members, *ngramjoin.tree_overlaps(probe, members, 75)):
        both = len(np.intersect1d(probe, m))
        assert low <= both <= high and (low == high or 100 * both < 75 * (len(probe) + len(m) - both))


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    near = {x: {x} for x in {n for e in links for n in e}}
    for u, v in links * 60:
        near[u] |= near[v]
        near[v] = near[u]
    changed = True
    least = {x: min(s) for x, s in near.items()}
    while changed:
        changed = False
        for u, v in links:
            m = min(least[u], least[v])
            changed |= least[u] != m or least[v] != m
            least[u] = least[v] = m
    assert got == {x: m for x, m in least.items() if x != m}


def test_repeated_passages(hard, hard_rows, nothing):
    got = suffixdedup.deduplicated(hard.withColumn("k", F.lit(1))).collect()
    assert ordered(got) == ordered(cut_repeats([r[:2] for r in hard_rows], 400))
    assert suffixdedup.deduplicated(nothing).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_passages_at_random(spark, seed):
    """Small windows over texts put together from shared pieces of all lengths."""
    rnd = random.Random(seed)
    parts = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 120))) for _ in range(12)]
    rows = [(i, "".join(rnd.choice(parts)[rnd.randrange(9):] for _ in range(rnd.randrange(6)))) for i in range(40)]
    got = suffixdedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), window=60, anchor=30).collect()
    assert ordered(got) == ordered(cut_repeats(rows, 60))


def test_mix(hard, hard_rows):
    got = mixing.plan(hard.withColumn("size", F.lit("old"))).collect()
    size = {}
    for r in hard_rows:
        size[r[3]] = size.get(r[3], 0) + len((r[1] or "").split())
    names = sorted((s for s in size if s is not None)) + [None]
    target = dict(zip(names, waterfill([size[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3)))
    taken = dict.fromkeys(names, 0)
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for n in names:  # as near as the documents of a small source allow
        assert abs(taken[n] - target[n]) <= max(r["size"] for r in got if r["source"] == n)
    assert ordered(mixing.plan(hard).collect()) == ordered(mixing.plan(hard.repartition(5)).collect())


def test_mix_on_the_corpus(spark, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.plan(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("m"), F.max("size").alias("s"))
    assert all(abs(r["t"] - r["m"]) < max(0.02 * r["m"], 0.5 * r["s"]) for r in got.collect())
    assert mixing.plan(nothing).count() == 0 and mixing.mixed(nothing).columns == nothing.columns
    assert mixing.mixed(docs).columns == docs.columns


def test_mix_caps(spark):
    """A source with the largest weight and few words is taken three times over, and its excess is shared out."""
    rows = [(i, "w " * 10, "a") for i in range(3)] + [(10 + i, "w " * 50, "b") for i in range(40)]
    got = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["copies"] for r in got if r["source"] == "a"} == {3}
    assert sum(r["taken"] for r in got) == pytest.approx(2030, abs=50)


def test_mix_of_one_row_a_thousand_times(spark):
    """Copies are spread over repeated rows, so that a source that is one row reaches its target."""
    rows = [(1, "w " * 50, "a")] * 1000 + [(10 + i, f"x{i} " * 50, "b") for i in range(400)] + [(None, "z " * 25, "c")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.plan(docs)
    per = {r["source"]: r for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("m")).collect()}
    assert all(abs(r["t"] - r["m"]) <= 0.02 * r["m"] + 50 for r in per.values()), per
    assert ordered(got.collect()) == ordered(mixing.plan(docs.coalesce(2)).collect()) and got.count() == 1900


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 10**12), (5, 0), (1000, 10), (1000, 10**9), (777, 777)):
        v = np.sort(rng.integers(-top - 1, top + 1, n))
        e = EliasFano.from_bytes(EliasFano.encode(v).to_bytes())
        assert e.decode().tolist() == v.tolist() and [e.select(i) for i in range(n)] == v.tolist()
    v = np.cumsum(rng.integers(1, 2000, 10000))
    assert len(EliasFano.encode(v).to_bytes()) < 2.2 * 10000  # a table of 64-bit offsets has 8 bytes each
    with pytest.raises(IndexError):
        e.select(777)


def test_token_output(spark, hard, hard_rows, nothing, tmp_path):
    tok = Tokenizer.from_file(BPE)
    tok.encode_special_tokens = True
    rows = hard_rows + [(400, "  a   b\n\n c \n  d ", "en", "a", 1), (401, "x<|endoftext|>y it's  ", "en", "a", 1), (402, " ", "en", "a", 1)]
    path = tokenout.write_tokens(spark.createDataFrame(rows, hard.schema).repartition(4), BPE, str(tmp_path / "t"))
    got = tokenout.read_tokens(spark, path).orderBy("start").collect()
    want = sorted(((r[0] is not None, r[0] or 0), tuple(tok.encode(r[1] or "", add_special_tokens=False).ids + [0])) for r in rows)
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got] == [w[0] for w in want]
    assert ordered((r["n_tokens"], r["ids_crc32"]) for r in got) == ordered(
        (len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for _, w in want)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert tokenout.read_document(spark, path, 12) == next(list(w) for k, w in want if k == (True, 12))
    assert tokenout.read_document(spark, path, 5000) == []
    assert tokenout.read_tokens(spark, tokenout.write_tokens(nothing, BPE)).count() == 0


def test_special_tokens_as_the_library_has_them(spark, nothing, tmp_path):
    """The query against an untouched tokenizer, on texts that hold a special token."""
    from sigloom.llm.queries import op9_token_output

    tok = Tokenizer.from_file(BPE)
    texts = ["x<|endoftext|>y", "x <|endoftext|> y", "x  <|endoftext|>  y z", "<|endoftext|>", " <|endoftext|><|endoftext|> ",
             "no token, it's  here ", "<|endoftext|", "a\n<|endoftext|>\n b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r["n_tokens"], r["ids_crc32"]) for r in op9_token_output(spark, str(tmp_path)).orderBy("doc_id").collect()]
    want = [tok.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert 50256 in want[0]
    assert got == [(len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for w in want]


def test_pieces_without_dropout_are_the_models(hard_rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [r[1] for r in hard_rows if r[1] and "▁" not in r[1]] + [" ", "  a  b ", "x" * 3000 + " y", "tab\tand\nline  "]
    e = sentencepieces.DropoutEncoder(sentencepieces.Pieces(MODEL), 0.0, 1, 0)
    ids, ends = e.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == [sp.encode(t) for t in texts]


def test_pieces_round_trip(spark, hard, hard_rows, nothing):
    df = sentencepieces.encoded(hard.withColumn("ids", F.lit(1)), MODEL, rate=0.3)
    back = sentencepieces.decoded(df, MODEL).collect()
    assert len(back) == len(hard_rows) and all(r["decoded"] == r["text"] for r in back)
    assert ordered(df.collect()) == ordered(sentencepieces.encoded(hard.repartition(1), MODEL, rate=0.3).collect())
    assert all((r["ids"] is None) == (r["text"] is None) for r in back)
    assert sentencepieces.decoded(sentencepieces.encoded(nothing, MODEL), MODEL).count() == 0


def test_dropout_varies_and_long_words_follow_the_same_rule():
    p = sentencepieces.Pieces(MODEL)
    e = [sentencepieces.DropoutEncoder(p, 0.3, 7, v) for v in range(3)]
    words = ["internationalization", "understanding", "the", "ñandú", "antidisestablishment"]
    cut = [tuple(map(tuple, (x.tolist() for x in x_.segment(words)))) for x_ in e]
    assert len(set(cut)) == 3
    alone = [x.tolist() for w in words for x in e[0].segment([w])]
    assert alone == [list(x) for x in cut[0]]  # whatever else is in the batch
    row = np.array([p.char[ord(c)] for c in " " + "internationaldevelopment" * 6])
    assert e[1]._merge_long(row).tolist() == [v for v in e[1]._merge_all(row[None])[0].tolist() if v != -2]


def test_nearest_on_the_table(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = ann.usable(t)
    got = ann.nearest(rows, rows.where(F.col("id") % 20 == 0)).collect()
    data = t.toPandas()
    x, ids = np.array(data.embedding.tolist(), np.float64), data.vec_id.to_numpy()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        best = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:20]
        mine = sorted(found[ids[i]])
        assert [m[0] for m in mine] == list(range(1, 21))
        hits.append(len({m[1] for m in mine} & set(ids[best].tolist())))
    assert np.mean(hits) / 20 >= 0.9


def test_blocks_split_a_repeated_id(spark):
    rows = spark.range(70000).select(F.lit(7).cast("long").alias("id")).unionByName(spark.range(100, 1100))
    sizes = [r["count"] for r in ann._dealt(rows, 9, "vb", 3).groupBy("vb").count().collect()]
    assert sum(sizes) == 71000 and len(sizes) == 9 and max(sizes) < 1.2 * 71000 / 9


def test_nearest_in_full_blocks():
    """Recall against brute force where LEAST plays no part: each block's share is 18 %."""
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((3 * ann.VECTORS_PER_BLOCK, 64)) + 2 * rnd.standard_normal((20, 64))[rnd.integers(0, 20, 3 * ann.VECTORS_PER_BLOCK)]
    ids, asked = np.arange(len(x)), np.arange(0, len(x), 512)
    best = {i: [] for i in asked}
    for b in range(3):
        own = np.flatnonzero(ids % 3 == b)
        assert 0.18 * len(own) > ann.LEAST
        for q, names, scores in ann._best(x[own], own, x[asked], asked, 20, 0.18, 128, 0.5, 0.7, 1.1, 3):
            best[q] += zip(-scores, names)
    hits = 0
    for i in asked:
        s = x @ x[i]
        want = [j for j in np.argsort(-s) if j != i][:20]
        hits += len(set(want) & {n for _, n in sorted(best[i])[:20]})
    assert hits / (20 * len(asked)) >= 0.9


def test_nearest_hard_rows(spark):
    rows = [(i, [float(i % 3), 1.0, 0.5], 1) for i in range(30)] + [
        (100, None, 1), (101, [], 1), (102, [0.0, 0.0, 0.0], 1), (103, [float("nan"), 1.0, 1.0], 1),
        (104, [None, 1.0, 1.0], 1), (105, [float("inf"), 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 1), (106, [1.0, 2.0], 1)]
    v = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = ann.nearest(v, v.where("id in (0, 106)"), k=5).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, i) for i in (1, 2, 3, 4, 5)]  # all scores tie
    assert {r["score"] for r in got} == {1.25}
    got = ann.nearest(v, v.where("id = 0"), k=50).collect()
    assert len(got) == 29  # all candidates, where they are fewer
    empty = v.where("id < 0")
    assert ann.nearest(empty, empty).count() == 0


def test_pipeline_stages(spark, hard, nothing):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "private_values", "mixing", "pieces"]
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumns(
        {c: F.lit(i) for i, c in enumerate(("kept", "k", "_row", "_hash", "words", "hits", "lam", "docs", "copies"))})
    start = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, d)
        assert docs.columns[:len(before.columns)] == before.columns, name
        rows = docs.count()
        assert 0 < rows <= (3 if name == "mixing" else 1) * start, name
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, d).count() == 0


def test_near_duplicates_leave_one_of_each(spark, hard, hard_rows):
    got = ngramjoin.one_of_each(hard)
    want = {(d, c) for d, _, c in jaccard_classes([r[:2] for r in hard_rows]) if d is not None}
    kept = [r["doc_id"] for r in got.where("doc_id is not null").collect()]
    assert got.columns == hard.columns and sorted(kept) == sorted({c for _, c in want})
