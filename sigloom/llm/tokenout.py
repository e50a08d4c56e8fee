"""Token-id output: concatenated id arrays with Elias-Fano document boundaries, and their reader.

A written set is a folder of Parquet part files (Spark commits them, any Hadoop path will do). Each row is one shard
of documents that follow each other in ascending doc_id order:

* ``ids``: the ids of all its documents, each closed by ``end_id``, little-endian, ``id_bytes`` each;
* ``ends``: the Elias-Fano coded end offsets of the documents in ``ids``;
* ``doc_ids``: the Elias-Fano coded doc_ids (the first ``n_null`` documents have none);
* ``first_id, tie, seq``: its place in the order; ``n_docs, n_ids``: its counts.

No table of 64-bit offsets is kept: offset i of a shard is ``EliasFano.select(i)``, and the ids before a shard are
the running sum of ``n_ids`` over one small row for each shard.

A text is cut at spaces that stand between a non-space and a non-blank, which the tokenizer's own splitter can never
join; each distinct piece is encoded once by the tokenizers library and remembered, in a cache of bounded size. A text
that holds the string of an added token is one piece.

Defined cases: null and empty texts give the end id alone; documents without a doc_id come first; rows of one doc_id
are ordered by the hash of their text; an empty table writes no shard and reads back as no row.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigloom.llm.common import column, scratch_dir, small_batches
from sigloom.llm.eliasfano import EliasFano

#: A shard is closed beyond so many ids.
SHARD_IDS = 1 << 22
#: The piece cache is renewed beyond so many pieces or characters.
CACHE_PIECES, CACHE_CHARS = 600_000, 24_000_000
#: Pieces that are encoded in one string.
TOGETHER = 256
SHARDS = ("first_id long, tie long, seq int, n_docs long, n_null long, n_ids long, id_bytes int, ids binary, "
          "ends binary, doc_ids binary")
_BLANKS = re.compile(r"\s ")
_SAFE = re.compile(r"(?<=\S) (?! )")


class _Numbers(dict):
    """Numbers keys as they come, with one look-up each; ``new`` lists those that have come since it was emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class PieceEncoder:
    """Ids of whole texts through a cache of pieces; a key is a piece after a space, or a 1-tuple for a text's first."""

    def __init__(self, path: str, ordinary: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = ordinary  # whether a special token's string in a text is ordinary text
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.wide = self.tok.get_vocab_size() > 1 << 16
        # one character of a token's name stands for one byte
        names = self.tok.get_vocab()
        self.bytes_of = np.zeros(max(names.values(), default=0) + 1, np.int64)
        self.bytes_of[list(names.values())] = [len(t) for t in names]
        self.clear()

    def clear(self) -> None:
        self.code = _Numbers()
        self.chars = 0
        self.start, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def pieces(self, text: str) -> list:
        if any(t in text for t in self.added):
            return [(text,)]
        parts = (_SAFE.split(text) if _BLANKS.search(text) else text.split(" "))
        parts[0] = (parts[0],)
        return parts

    def _encoded(self, strings: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(strings, add_special_tokens=False)]

    def _learn(self, new: list) -> None:
        """Pieces that begin and end with visible characters are encoded many in one string: the tokenizer's splitter never
        joins them, and since a token's length in bytes is known, each piece's share of the ids is too."""
        m = len(new)
        n = len(self.code) - m
        if n + m > len(self.start):
            self.start, self.count = (np.resize(x, 2 * (n + m)) for x in (self.start, self.count))
        alone, together = [], []
        for i, k in enumerate(new):
            plain = k.__class__ is str and k and not k[0].isspace() and not k[-1].isspace()
            (together if plain else alone).append(i)
        groups = [together[i:i + TOGETHER] for i in range(0, len(together), TOGETHER)]
        for group, ids in zip(groups, self._encoded([" " + " ".join([new[i] for i in g]) for g in groups])):
            ends = np.cumsum(self.bytes_of[ids])
            wanted = np.cumsum(np.fromiter([len(new[i].encode("utf-8", "surrogatepass")) + 1 for i in group], np.int64, len(group)))
            at = np.searchsorted(ends, wanted)
            if at[-1] >= len(ends) or (ends[at] != wanted).any():  # a tokenizer that rewrites its text
                alone += group
                continue
            self._keep(n + np.array(group), ids, np.diff(at + 1, prepend=0))
        if alone:
            found = self._encoded([k[0] if isinstance(k, tuple) else " " + k for k in (new[i] for i in alone)])
            self._keep(n + np.array(alone), np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found)))
        self.chars += sum(map(len, new))

    def _keep(self, numbers: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """The ids of the pieces of these numbers, ``count`` each."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * (self.used + len(ids)))
        self.pool[self.used:self.used + len(ids)] = ids
        self.count[numbers] = count
        self.start[numbers] = self.used + np.cumsum(count) - count
        self.used += len(ids)

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text closed by ``end_id``, and the end offset of each text."""
        if len(self.code) > CACHE_PIECES or self.chars > CACHE_CHARS:
            self.clear()
        split = [self.pieces(t) for t in texts]
        n_pieces = np.fromiter(map(len, split), np.int64, len(split))
        flat = list(chain.from_iterable(split))
        code = np.fromiter(map(self.code.__getitem__, flat), np.int64, len(flat))
        if self.code.new:
            self._learn(self.code.new)
            self.code.new = []
        count = self.count[code]
        before = np.cumsum(count) - count
        total = int(count.sum())
        at = np.arange(total) + np.repeat(self.start[code] - before, count)
        cut = np.concatenate([before, [total]])[np.cumsum(n_pieces)]
        ends = cut + np.arange(1, len(texts) + 1)
        out = np.full(total + len(texts), end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[ends - 1] = False
        out[keep] = self.pool[at]
        return out, ends


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def _encoder(path: str, ordinary: bool) -> PieceEncoder:
    if (path, ordinary) not in _encoders:
        _encoders[path, ordinary] = PieceEncoder(path, ordinary)
    return _encoders[path, ordinary]


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 0, ordinary: bool = True) -> str:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order; returns the folder.

    ``ordinary`` takes the string of a special token in a text as ordinary text; without it, the text has the token's
    id, as the tokenizers library gives by default.
    """
    path = path or f"{scratch_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer, ordinary)
        size = 4 if enc.wide else 2
        seq, held, n_held = 0, [], 0

        def shard() -> pa.RecordBatch:
            ids = np.concatenate([h[0] for h in held])
            sizes = [len(h[0]) for h in held]
            ends = np.concatenate([h[1] + b for h, b in zip(held, np.cumsum([0, *sizes]))])
            named = pa.chunked_array([h[2] for h in held]).combine_chunks()
            known = named.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            return pa.RecordBatch.from_pydict({
                "first_id": pa.array([named[0].as_py()], pa.int64()), "tie": pa.array([held[0][3]], pa.int64()),
                "seq": pa.array([seq], pa.int32()), "n_docs": [len(ends)], "n_null": [named.null_count],
                "n_ids": [len(ids)], "id_bytes": pa.array([size], pa.int32()),
                "ids": pa.array([ids.astype(f"<u{size}").tobytes()], pa.binary()),
                "ends": pa.array([EliasFano.encode(ends).to_bytes()], pa.binary()),
                "doc_ids": pa.array([EliasFano.encode(known).to_bytes()], pa.binary())})

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [t or "" for t in column(part, "text").to_pylist()]
                ids, ends = enc.encode(texts, end_id)
                held.append((ids, ends, column(part, "doc_id"), column(part, "tie")[0].as_py()))
                n_held += len(ids)
                if n_held >= SHARD_IDS:
                    yield shard()
                    seq, held, n_held = seq + 1, [], 0
        if held:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.xxhash64("text").alias("tie"))
    small_batches(rows).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").mapInArrow(
        run, SHARDS).write.option("compression", "zstd").parquet(path)
    return path


def read_tokens(spark, path: str) -> DataFrame:
    """One row for each document of a written set: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.schema(SHARDS).parquet(path)
    key = ["first_id", "tie", "seq"]
    # one small row for each shard
    order = Window.orderBy(F.asc_nulls_first("first_id"), "tie", "seq").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select(*key, "n_ids").select(*key, F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], f"<u{r['id_bytes']}")
                ends = EliasFano.from_bytes(r["ends"]).decode()
                starts = np.concatenate([[0], ends[:-1]])
                named = EliasFano.from_bytes(r["doc_ids"]).decode()
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends)]
                n = len(ends)
                yield pa.RecordBatch.from_pydict({
                    **{k: pa.array([r[k]] * n, pa.int32() if k == "seq" else pa.int64()) for k in key},
                    "doc_id": pa.array([None] * r["n_null"] + named.tolist(), pa.int64()),
                    "own": pa.array(starts, pa.int64()), "n_tokens": pa.array(ends - starts, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64())})

    rows = shards.mapInArrow(run, "first_id long, tie long, seq int, doc_id long, own long, n_tokens long, ids_crc32 long")
    on = rows["first_id"].eqNullSafe(base["first_id"]) & (rows["tie"] == base["tie"]) & (rows["seq"] == base["seq"])
    return rows.join(base, on).select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark, path: str, doc_id: int) -> list[int]:
    """The ids of one document, by select on the boundaries of its shard (the end id included)."""
    for r in spark.read.schema(SHARDS).parquet(path).where(F.coalesce(F.col("first_id") <= doc_id, F.lit(True))).orderBy(
            F.desc_nulls_last("first_id"), F.desc("tie"), F.desc("seq")).limit(1).collect():
        named = EliasFano.from_bytes(r["doc_ids"])
        ends = EliasFano.from_bytes(r["ends"])
        lo, hi = 0, named.n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if named.select(mid) < doc_id else (lo, mid)
        if lo < named.n and named.select(lo) == doc_id:
            i = lo + r["n_null"]
            ids = np.frombuffer(r["ids"], f"<u{r['id_bytes']}")
            return ids[ends.select(i - 1) if i else 0:ends.select(i)].tolist()
    return []
