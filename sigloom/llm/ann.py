"""Approximate nearest neighbours by collision-counting hashing, largest inner product first.

Inner products become distances by one more coordinate, sqrt(max_norm^2 - norm^2). Every block of vectors keeps, for
each of ``projections`` random lines, its projections in sorted order. A query opens a window around its own
projection on every line; the windows widen by ``widen`` (virtual rehashing: no table is built anew, a wider window is
a longer range of the same sorted array), and a vector that stands in the windows of ``share`` of all lines is a
candidate. When a block has ``k`` plus ``verify`` of its rows (LEAST at least) as candidates, they are verified with the exact inner
product in double precision. Windows that have grown over the whole block make every row a candidate, so no query comes back short.

Vectors and queries are dealt into blocks of bounded size, and each pair of blocks is one task's work: its memory
does not grow with the table, and no query set or index is broadcast. The best ``k`` of each block are merged.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows without an id,
take no part; vectors of different lengths are not compared; ties go to the smaller id; rows that repeat the query's
id are its own. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigloom.llm.common import saved
from sigloom.session import broadcast_if_small

#: Blocks stay far below 2^16 rows (places are 16-bit), and lines below 2^8.
VECTORS_PER_BLOCK, QUERIES_PER_BLOCK = 8192, 2048
#: Candidates that are verified in a block at least, where it has so many.
LEAST = 800


def usable(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, dim and v (array of double) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = (F.col(id_col).isNotNull() & v.isNotNull() & F.exists(v, lambda x: x != 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.where(F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.size(v).alias("dim"), v.alias("v"))


class CollisionIndex:
    """Sorted projections of one block, and every row's place in them."""

    def __init__(self, x: np.ndarray, projections: int, seed: int):
        norm2 = (x * x).sum(1)
        self.x, self.top = x, math.sqrt(norm2.max())
        lines = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, projections))
        p = (x @ lines[:-1] + np.sqrt(np.maximum(0, self.top ** 2 - norm2))[:, None] * lines[-1]).T
        order = np.argsort(p, axis=1, kind="stable")
        self.sorted = np.take_along_axis(p, order, 1)
        self.place = np.empty(p.shape, np.uint16)
        np.put_along_axis(self.place, order, np.arange(len(x), dtype=np.uint16)[None], 1)
        self.lines = lines[:-1]

    def candidates(self, q: np.ndarray, wanted: int, share: float, width: float, widen: float):
        """For each query row of ``q``, the rows of this block whose collisions reach the threshold."""
        n, m = len(self.x), len(self.sorted)
        need = math.ceil(share * m)
        at = (q / np.sqrt((q * q).sum(1))[:, None] * self.top) @ self.lines
        out: list = [None] * len(q)
        shift, inside = np.empty_like(self.place), np.empty(self.place.shape, bool)
        open_, half = np.arange(len(q)), width * self.top
        while len(open_):
            low = np.stack([np.searchsorted(self.sorted[j], at[open_, j] - half) for j in range(m)], 1)
            high = np.stack([np.searchsorted(self.sorted[j], at[open_, j] + half, "right") for j in range(m)], 1)
            left = []
            for r, i in enumerate(open_.tolist()):
                # a row stands in a line's window where its place does; below it, the difference wraps round
                np.subtract(self.place, low[r].astype(np.uint16)[:, None], out=shift)
                np.less(shift, (high[r] - low[r]).astype(np.uint16)[:, None], out=inside)
                found = np.flatnonzero(np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8) >= need)
                if len(found) >= min(n, wanted):
                    out[i] = found
                else:
                    left.append(i)
            open_ = np.array(left, np.int64)
            half *= widen
        return out


def _best(x, ids, q, q_ids, k, verify, projections, share, width, widen, seed):
    """The k best of one block for each query: query id, id and score."""
    index = CollisionIndex(x, projections, seed)
    wanted = k + 1 + max(LEAST, math.ceil(verify * len(x)))
    for first in range(0, len(q), 256):
        part = q[first:first + 256]
        for r, found in enumerate(index.candidates(part, wanted, share, width, widen)):
            score = np.einsum("ij,j->i", x[found], part[r])
            name = ids[found]
            other = name != q_ids[first + r]
            score, name = score[other], name[other]
            if len(score) > 4 * k:
                cut = np.partition(score, len(score) - k)[len(score) - k]
                score, name = score[score >= cut], name[score >= cut]
            best = np.lexsort((name, -score))[:k]
            yield q_ids[first + r], name[best], score[best]


def _dealt(rows: DataFrame, n: int, name: str, seed: int) -> DataFrame:
    """``rows`` of a saved table with their block of ``n``: by id, and each row by itself where an id is repeated."""
    again = rows.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_c")).where("_c > 1").select("_id")
    own = rows.withColumn("_at", F.monotonically_increasing_id()).join(broadcast_if_small(again), F.col("id") == F.col("_id"), "left")
    salt = F.when(F.col("_id").isNotNull(), F.col("_at"))
    return own.withColumn(name, F.pmod(F.xxhash64("id", F.lit(seed), salt), F.lit(n)).cast("int")).drop("_id", "_at")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, projections: int = 128, share: float = 0.5,
            width: float = 0.7, widen: float = 1.1, verify: float = 0.18, seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found; both inputs come from ``usable``."""
    vectors, queries = saved(vectors), saved(queries)
    n_v = max(1, math.ceil(vectors.count() / VECTORS_PER_BLOCK))
    n_q = max(1, math.ceil(queries.count() / QUERIES_PER_BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    parts = _dealt(vectors, n_v, "vb", seed).select(F.lit(False).alias("asks"), "*", each(n_q).alias("qb")).unionByName(
        _dealt(queries, n_q, "qb", seed).select(F.lit(True).alias("asks"), "*", each(n_v).alias("vb")))

    def run(key, table):
        asks = table.column("asks").to_numpy()
        ids = table.column("id").to_numpy()
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        got = []
        if asks.any() and not asks.all():
            got = list(_best(v[~asks], ids[~asks], v[asks], ids[asks], k, verify, projections, share, width, widen, seed))
        return pa.table({
            "query_id": pa.array(np.repeat([g[0] for g in got], [len(g[1]) for g in got]).astype(np.int64)),
            "vec_id": pa.array(np.concatenate([g[1] for g in got] or [[]]).astype(np.int64)),
            "score": pa.array(np.concatenate([g[2] for g in got] or [[]]).astype(np.float64))})

    found = parts.groupBy("vb", "qb", "dim").applyInArrow(run, "query_id long, vec_id long, score double")
    # k rows of each block for a query
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
