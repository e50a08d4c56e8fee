"""Quality rules: counted base rules, and a calibrated hashed n-gram logistic regression learned from labelled rows.

The model sees hashed words, word pairs and 4-byte strings. It is fitted on a bounded sample of labelled documents
(``max_fit``, lowest keyed hash first), two thirds for the weights and one third for the calibration, and broadcast:
its size is fixed by ``DIMS``. Whole texts are then scored in Arrow batches; no row is shuffled.

Defined cases: a null or empty text has no words, so it fails the base rule (``n_words < 50``). Labels that are null
or name no document are not used; several labels of one document count as their minimum. Without labels of both
kinds the model keeps everything and the base rules decide alone. Repeated rows are scored alike. A measure replaces
an input column of its name in ``measured``; ``accepted`` returns the input columns untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import (U64, WHITE, column, gram_hash, mix, prefix_hash, small_batches, span_hash, text_blocks, words_of)

DIMS = 1 << 16
MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "base_failed boolean, quality_prob double, kept boolean")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass
class QualityModel:
    """Weights of the three hashed groups; ``prob = sigmoid(scale * logit + shift)``; kept from ``threshold`` on."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(3 * DIMS, np.float32))
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 20.0
    threshold: float = 0.5
    fitted_on: int = 0


def _features(buf: np.ndarray, off: np.ndarray, hashed: np.ndarray, doc: np.ndarray):
    """(feature index, text) of every word, word pair and 4-byte string of a block, as three groups."""
    yield (hashed >> U64(48)).astype(np.int64), doc
    pair = gram_hash(hashed, 2)
    same = doc[1:] == doc[:-1]
    yield (pair >> U64(48)).astype(np.int64)[same] + DIMS, doc[:-1][same]
    n = len(buf) - 3
    if n <= 0:
        yield np.zeros(0, np.int64), np.zeros(0, np.int64)
        return
    b = buf.astype(np.uint32)
    gram = (b[:n] | b[1:n + 1] << np.uint32(8) | b[2:n + 2] << np.uint32(16) | b[3:] << np.uint32(24))
    at = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64) + 2 * DIMS
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    whole = owner[:n] == owner[3:]
    yield at[whole], owner[:n][whole]


def _hashed_words(buf: np.ndarray, off: np.ndarray):
    start, end, doc = words_of(buf, off)
    return span_hash(prefix_hash(buf), start, end), doc


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct features of each labelled text with their share of the group, for the fit."""
    for batch in batches:
        label = column(batch, "quality").to_numpy(zero_copy_only=False)
        for first, off, buf in text_blocks(column(batch, "text")):
            n = len(off) - 1
            hashed, doc = _hashed_words(buf, off)
            parts = []
            for at, owner in _features(buf, off, hashed, doc):
                key, count = np.unique(owner * (3 * DIMS) + at, return_counts=True)
                row = key // (3 * DIMS)
                total = np.bincount(row, count, n)
                parts.append((row, (key % (3 * DIMS)).astype(np.int32), (count / total[row]).astype(np.float32)))
            row, at, share = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(row, kind="stable")
            cut = np.searchsorted(row[order], np.arange(n + 1))
            at, share = at[order], share[order]
            yield pa.RecordBatch.from_pydict({
                "quality": pa.array(label[first:first + n].astype(np.int32), pa.int32()),
                "at": pa.array([at[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                "share": pa.array([share[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())})


def _logistic(ptr, at, share, y, weight, rounds, ridge):
    """Full-batch Adam on the weighted log loss; ``ptr`` cuts the rows."""
    owner = np.repeat(np.arange(len(y)), np.diff(ptr))
    w, b = np.zeros(3 * DIMS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(owner, share * w[at], len(y)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        gw, gb = np.bincount(at, share * g[owner], 3 * DIMS) + ridge * w, g.sum()
        m, v = .9 * m + .1 * gw, .99 * v + .01 * gw * gw
        mb, vb = .9 * mb + .1 * gb, .99 * vb + .01 * gb * gb
        w -= .5 * (m / (1 - .9 ** t)) / (np.sqrt(v / (1 - .99 ** t)) + 1e-7)
        b -= .1 * (mb / (1 - .9 ** t)) / (math.sqrt(vb / (1 - .99 ** t)) + 1e-7)
    return w, b


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for ``sigmoid(a z + c)`` on held-out rows, with Platt's smoothed targets."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    t = np.where(y > 0, hi, lo)
    x = np.stack([z, np.ones_like(z)])
    beta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
        h = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x @ (p - t))
        beta = beta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit_quality(docs: DataFrame, labels: DataFrame, max_fit: int = 1500, rounds: int = 80, ridge: float = 1e-6,
                threshold: float = 0.5) -> QualityModel:
    """Fit on at most ``max_fit`` labelled documents (lowest hash of the id first)."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    # at most max_fit rows
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(max_fit)
    # one text of each doc_id
    texts = small_batches(docs).select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(
        F.min("text").alias("text"))
    rows = texts.mapInArrow(_feature_rows, "quality int, at binary, share binary").collect()
    rows.sort(key=lambda r: (r["at"], r["quality"]))  # row order does not reach the fit
    y = np.array([float(r["quality"] > 0) for r in rows])
    if len(set(y)) < 2:
        return QualityModel(threshold=threshold)
    at = [np.frombuffer(r["at"], np.int32) for r in rows]
    share = [np.frombuffer(r["share"], np.float32) for r in rows]
    held = np.arange(len(rows)) % 3 == 2
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(rows), bool)

    def packed(pick):
        k = np.flatnonzero(pick)
        return (np.concatenate([[0], np.cumsum([len(at[i]) for i in k])]), np.concatenate([at[i] for i in k]),
                np.concatenate([share[i] for i in k]))

    ptr, a, s = packed(~held)
    # both kinds weigh the same in the weights; the calibration restores the true rates
    each = np.where(y[~held] > 0, .5 / y[~held].sum(), .5 / (1 - y[~held]).sum())
    w, b = _logistic(ptr, a, s, y[~held], each, rounds, ridge)
    ptr, a, s = packed(held if held.any() else ~held)
    z = np.bincount(np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)), s * w[a], len(ptr) - 1) + b
    scale, shift = _platt(z, y[held if held.any() else ~held])
    return QualityModel(w.astype(np.float32), float(b), scale, shift, threshold, len(rows))


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def measures(texts: pa.Array, model: QualityModel) -> dict[str, np.ndarray]:
    """The measures of every text of a batch."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    parts: dict[str, list[np.ndarray]] = {k: [np.zeros(0)] * 0 for k in names}
    for _, off, buf in text_blocks(texts):
        n = len(off) - 1
        start, end, doc = words_of(buf, off)
        prefix = prefix_hash(buf)
        hashed = span_hash(prefix, start, end)
        own = doc.astype(U64) * U64(0xA24BAED4963EE407)
        n_words = np.bincount(doc, minlength=n)
        # lines: they end at a line feed or with the text
        ends = np.union1d(np.flatnonzero(buf == 10), off[1:][off[1:] > off[:-1]])
        begins = np.concatenate([[0], ends[:-1] + (buf[np.minimum(ends[:-1], len(buf) - 1)] == 10)]) if len(ends) else ends
        begins = np.minimum(begins, ends)
        full = np.searchsorted(start, begins) < np.searchsorted(start, ends)
        begins, ends = begins[full], ends[full]
        line_doc = np.searchsorted(off, begins, "right") - 1
        key = mix(span_hash(prefix, begins, ends) + line_doc.astype(U64) * U64(0xA24BAED4963EE407))
        _, at = np.unique(key, return_index=True)
        n_dup = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[at], minlength=n)
        # words that stand in a repeated three-word window
        covered = np.zeros(len(hashed), bool)
        if len(hashed) > 2:
            window = mix(gram_hash(hashed, 3) + own[:-2])
            inside = np.flatnonzero(doc[2:] == doc[:-2])
            _, inverse, count = np.unique(window[inside], return_inverse=True, return_counts=True)
            again = inside[count[inverse] > 1]
            for i in range(3):
                covered[again + i] = True
        logit = np.full(n, model.bias)
        for at, owner in _features(buf, off, hashed, doc):
            logit += np.bincount(owner, model.weights[at], n) / np.maximum(1, np.bincount(owner, minlength=n))
        prob = 1 / (1 + np.exp(-np.clip(model.scale * logit + model.shift, -700, 700)))
        n_repeat = np.bincount(doc[covered], minlength=n)
        failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
        got = {"n_words": n_words, "word_chars": _per_text(~WHITE[buf] & (buf & 0xC0 != 0x80), off),
               "n_symbols": _per_text(SYMBOLS[buf], off), "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
               "base_failed": failed, "quality_prob": prob, "kept": ~failed & (prob >= model.threshold)}
        for k in names:
            parts[k].append(got[k])
    return {k: np.concatenate(v) if v else np.zeros(0) for k, v in parts.items()}


def measured(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with the measures; a column of a measure's name is replaced."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    kinds = [x.split()[1] for x in MEASURES.split(", ")]
    to = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    rest = [c for c in docs.columns if c not in names or c == "text"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*rest).schema
    for n, k in zip(names, kinds):
        schema = schema.add(n, k)

    def run(batches):
        for batch in batches:
            got = measures(column(batch, "text"), shared.value)
            yield pa.RecordBatch.from_arrays(
                [column(batch, c) for c in rest]
                + [pa.array(got[n].astype(bool) if k == "boolean" else got[n], to[k]) for n, k in zip(names, kinds)],
                names=rest + names)

    return small_batches(docs).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The documents that are kept, columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(measures(column(batch, "text"), shared.value)["kept"].astype(bool)))

    return small_batches(docs).mapInArrow(run, docs.schema)
