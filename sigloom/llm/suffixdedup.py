"""Repeated passages by a depth-limited radix sort of suffixes: every byte that lies in a repeated window goes.

Suffixes are told apart through their first ``window`` bytes only, in most-significant-digit passes: each pass groups
the suffixes that are still equal by one more digit, and groups of one drop out. Groups that are left after the last
digit are exactly the repeated windows. Digits are 64-bit hashes of fixed byte ranges of the window:

1. its anchor, the ``anchor``-byte string of least hash in it. Equal windows have equal anchors at equal places, and
   neighbouring windows mostly share theirs, so one row stands for about a hundred suffixes;
2. for suffixes whose anchor occurs again, in blocks of STEP neighbours: the core, the bytes that all windows of the
   block share, and the hull, the bytes that any of them has. Where the whole hull occurs again, the block is done;
3. the whole window, for the blocks (one of each distinct hull) whose core occurs with different hulls.

Rows are hashes and places, never text; a group's members are only counted (partial sums before the shuffle), so a
passage that a third of all documents share is no heavier than others. Texts are shuffled once, for the documents
with a shared anchor.

Defined cases: null and empty texts have 0 bytes and the digest of the empty string; texts under ``window`` bytes lose
nothing; rows that repeat count as other places and lose their windows like copies; documents without a doc_id are
treated like others. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import U64, column, mix, prefix_hash, saved, small_batches, span_hash, text_blocks

WINDOW, ANCHOR, STEP = 400, 200, 25
PLACE = np.uint64(0xFFFFFFFF)


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(v) - w + 1
    full = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:len(v)] = v
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1:w - 1 + n])


def anchors_of(buf: np.ndarray, off: np.ndarray, window: int, anchor: int):
    """Runs of windows with one anchor: text, anchor place, first and last window (places in ``buf``), anchor hash."""
    none = np.zeros(0, np.int64)
    if len(buf) < window:
        return none, none, none, none, np.zeros(0, U64)
    prefix = prefix_hash(buf)
    at = np.arange(len(buf) - anchor + 1)
    gram = span_hash(prefix, at, at + anchor)
    least = _sliding_min((gram & ~PLACE) | at.astype(U64), window - anchor + 1)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    n = len(buf) - window + 1
    s = np.flatnonzero(owner[:n] == owner[window - 1:])
    a = (least[s] & PLACE).astype(np.int64)
    cut = np.ones(len(s), bool)
    cut[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(s)) - 1 if len(s) else first
    return owner[s[first]], a[first], s[first], s[last], gram[a[first]]


def _anchor_rows(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = column(batch, "k").to_numpy()
            for first, off, buf in text_blocks(column(batch, "text")):
                doc, a, lo, hi, h = anchors_of(buf, off, window, anchor)
                base = off[doc]
                yield pa.RecordBatch.from_pydict({
                    "h": h.view(np.int64), "k": keys[first + doc], "a": (a - base).astype(np.int32),
                    "lo": (lo - base).astype(np.int32), "hi": (hi - base).astype(np.int32)})

    return run


def _ragged(batch: pa.RecordBatch, name: str, fields: list[str], first: int, n: int, base: np.ndarray):
    """Structs of n lists from row ``first`` on: the list's row, and each field moved to its text's place."""
    part = column(batch, name).slice(first, n)
    size = np.array(part.value_lengths().to_pylist(), np.int64)
    row = np.repeat(np.arange(n), size)
    flat = part.flatten()
    move = np.repeat(base[:n], size)
    return row, [flat.field(f).to_numpy().astype(np.int64) + move for f in fields]


def _block_rows(window: int):
    core_size = window - STEP + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = column(batch, "k").to_numpy()
            for first, off, buf in text_blocks(column(batch, "text")):
                n = len(off) - 1
                row, (a, lo, hi) = _ragged(batch, "runs", ["a", "lo", "hi"], first, n, off)
                b0, b1 = (a - hi) // STEP, (a - lo) // STEP
                times = b1 - b0 + 1
                pick = np.repeat(np.arange(len(a)), times)
                b = b0[pick] + np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times)
                top = a[pick] - STEP * b  # the last window start of the block
                s_lo, s_hi = np.maximum(lo[pick], top - STEP + 1), np.minimum(hi[pick], top)
                prefix = prefix_hash(buf)
                hull = mix(span_hash(prefix, s_lo, s_hi + window) + (a[pick] - s_lo).astype(U64) * U64(0x9E3779B97F4A7C15))
                core = mix(span_hash(prefix, top, top + core_size) + b.astype(U64) * U64(0xC2B2AE3D27D4EB4F))
                base = off[row[pick]]
                yield pa.RecordBatch.from_pydict({
                    "core": core.view(np.int64), "hull": hull.view(np.int64), "k": keys[first + row[pick]],
                    "lo": (s_lo - base).astype(np.int32), "hi": (s_hi - base).astype(np.int32)})

    return run


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = column(batch, "k").to_numpy()
            for first, off, buf in text_blocks(column(batch, "text")):
                n = len(off) - 1
                row, (lo, hi) = _ragged(batch, "reps", ["lo", "hi"], first, n, off)
                alone = column(batch, "reps").slice(first, n).flatten().field("alone").to_numpy(zero_copy_only=False)
                times = hi - lo + 1
                pick = np.repeat(np.arange(len(lo)), times)
                s = lo[pick] + np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times)
                digit = span_hash(prefix_hash(buf), s, s + window)
                yield pa.RecordBatch.from_pydict({
                    "digit": digit.view(np.int64), "k": keys[first + row[pick]],
                    "s": (s - off[row[pick]]).astype(np.int32), "alone": alone[pick]})

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for text, spans in zip(column(batch, "text"), column(batch, "spans")):
                raw = text.as_buffer().to_pybytes()
                flat = spans.values
                lo, hi = flat.field("lo").to_numpy().astype(np.int64), flat.field("hi").to_numpy().astype(np.int64)
                step = np.bincount(lo, minlength=len(raw) + 1)[:len(raw) + 1] - np.bincount(
                    hi + window, minlength=len(raw) + 1)[:len(raw) + 1]
                gone = np.cumsum(step)[:-1] > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                starts = gone.copy()
                starts[1:] &= ~gone[:-1]
                got.append((int(gone.sum()), int(starts.sum()), hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "k"), *[pa.array([g[i] for g in got], t) for i, t in enumerate(
                    (pa.int64(), pa.int64(), pa.string(), pa.binary()))]],
                names=["k", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def repeated_windows(keyed: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """From (k, text): the texts that have a shared anchor, and k with its ``spans`` (lo, hi) of repeated windows."""
    # first digit
    anchors = saved(small_batches(keyed).mapInArrow(_anchor_rows(window, anchor), "h long, k long, a int, lo int, hi int"))
    again = anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    runs = anchors.join(again, "h").groupBy("k").agg(F.collect_set(F.struct("a", "lo", "hi")).alias("runs"))
    texts = saved(keyed.join(runs.hint("shuffle_hash"), "k"), "snappy")
    # second digit, for blocks of suffixes
    blocks = saved(texts.mapInArrow(_block_rows(window), "core long, hull long, k long, lo int, hi int"))
    hulls = saved(blocks.groupBy("core", "hull").agg(
        F.count("*").alias("n"), F.min(F.struct("k", "lo", "hi")).alias("rep")))
    done = blocks.join(hulls.where("n > 1").select("core", "hull"), ["core", "hull"]).select("k", "lo", "hi")
    # last digit, where blocks of one core differ
    mixed = hulls.groupBy("core").agg(F.count("*").alias("m")).where("m > 1").select("core")
    reps = hulls.join(mixed, "core").select("rep.*", (F.col("n") == 1).alias("alone")).groupBy("k").agg(
        F.collect_list(F.struct("lo", "hi", "alone")).alias("reps"))
    first = texts.groupBy("k").agg(F.first("text").alias("text"))  # repeated rows have one k
    windows = saved(first.join(reps, "k").mapInArrow(_window_rows(window), "digit long, k long, s int, alone boolean"))
    equal = windows.groupBy("digit").agg(F.count("*").alias("n")).where("n > 1").select("digit")
    late = windows.where("alone").join(equal, "digit").select("k", F.col("s").alias("lo"), F.col("s").alias("hi"))
    spans = done.unionByName(late).groupBy("k").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return first, spans


def deduplicated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; ``kept`` (bytes) too if asked for."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.xxhash64("doc_id", text).alias("k"), text.alias("text"))
    first, spans = repeated_windows(keyed, window, anchor)
    cut = first.join(spans, "k").mapInArrow(_cut(window), "k long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    cut = cut if with_text else cut.drop("kept")
    cut = cut.withColumnRenamed("kept_sha256", "_sha")
    base = docs.select("doc_id", F.xxhash64("doc_id", text).alias("k"), F.octet_length(text).cast("long").alias("n_bytes"),
                       F.sha2(text, 256).alias("_whole"), *([text.alias("_text")] if with_text else []))
    out = base.join(cut, "k", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("_sha", "_whole").alias("kept_sha256"),
        *([F.coalesce("kept", F.encode("_text", "UTF-8")).alias("kept")] if with_text else []))
    return out
