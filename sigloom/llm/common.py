"""Shared tables for intermediate results, and numpy views of text batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sigloom.session import ensure_checkpoint_dir

#: Bytes of text that are handled in one numpy block; a longer document is a block of its own.
BLOCK_BYTES = 1 << 19
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1024
U64 = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ROOT = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach: ``spark.checkpoint.dir``, or a temporary one on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        ensure_checkpoint_dir(spark)
        path = spark.sparkContext.getCheckpointDir()
    return path


def saved(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: a lineage cut with column pruning."""
    path = f"{scratch_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove saved tables. Only for tables that nothing reads any more: what came of them must be saved itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session sends at most BATCH_ROWS rows to Python at once from now on.

    Texts are long: the usual 10,000 rows are tens of MB in the JVM and again in each worker. The setting is read when
    a plan runs, which may be after an operator has returned, so it stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer(name: str) -> str:
    """Where a public vocabulary is installed (the same place on every executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of whole texts: first row, byte offsets (from 0, one more than texts) and the bytes; a null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        last = min(last, len(texts))
        yield first, off[first:last + 1] - off[first], raw[off[first]:off[last]]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, up to n at least."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        for name, base in (("up", ROOT), ("down", pow(ROOT, -1, 1 << 64))):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running polynomial hash; the hash of bytes [a, b) follows from the values at a and b alone."""
    up, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * up[:len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every word (white space is space and \\t to \\r); texts never share a word."""
    inside = ~WHITE[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = off[:-1] < off[1:]
    a, b = off[:-1][full], off[1:][full] - 1
    first[a] = inside[a]
    last[b] = inside[b]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def gram_hash(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes (one for each place where n words follow)."""
    size = max(0, len(word) - n + 1)
    total = np.full(size, n, U64)
    for i in range(n):
        total = (total ^ word[i:i + size]) * U64(0x9FB21C651E98DF25)
        total ^= total >> U64(29)
    return mix(total)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where the key changes, from batches sorted by ``keys``: no key is cut in two.

    A table holds one batch plus the rest of its last key, so it is bounded where the keys' groups are.
    """
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = column(batch, k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            if kept:
                change[0] |= v[0] != column(kept[-1], k)[-1].as_py()
        cuts = np.flatnonzero(change)
        if len(cuts):
            last = int(cuts[-1])
            kept.append(batch.slice(0, last))
            yield pa.Table.from_batches([b for b in kept if b.num_rows] or [batch.slice(0, 0)])
            kept = [batch.slice(last)]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)
