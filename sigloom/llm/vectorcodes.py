"""Vector codes by product quantisation on whole numbers, with a lexicographic trie over the distinct parts.

A component x becomes floor(256 * x); a vector is cut into ``parts`` equal consecutive parts, and each part position
has a codebook of up to ``entries`` entries. The codebooks start as the parts of the first vectors and are moved
``rounds`` times to the floored mean of the parts that are nearest to them.

The nearest entries come from a trie of the distinct parts of a block of vectors, one trie a position. Its nodes are
visited depth first: a node's vector of distances to all entries is its parent's plus the squared differences in one
more dimension, so parts with a common prefix share all sums of that prefix. At a leaf the distances are complete;
their argmin is the code, and the leaf's components enter the new entry's sums weighted by how often the part occurs.
Leaves are taken in runs of LEAVES; the path to the last leaf of a run is carried into the next, so that memory
depends on LEAVES, entries and part width alone.

Every task builds tries of its own rows and returns sums for (position, entry): nothing but those small sums is
shuffled, and codes stand beside their vectors without a join. A vector that a third of all rows repeat is one leaf.

Defined cases: vectors that are null or hold null or non-finite components are dropped. Vectors of different lengths
have codebooks of their own. A length that ``parts`` does not divide (0 included) is filled up with zeros. Components
beyond +-2^27 (x beyond +-524288) are held there, and sums of errors at 2^63-1. First vectors are those with the
smallest ids, equal ids in order of their components; a null id is last and serves only where there is no other. Ties
go to the lower entry. Extra columns are neither read nor returned, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sigloom.llm.common import column, saved
from sigloom.session import broadcast_if_small

#: Leaves of a trie that are visited in one step, and vectors whose parts make up one trie.
LEAVES, BLOCK_ROWS = 8192, 32768
BOUND = 1 << 27
MOST = (1 << 63) - 1


@dataclass
class Codebooks:
    """Entries for each vector length: an array (part, entry, component)."""

    by_length: dict[int, np.ndarray]

    def sha256(self, length: int) -> str:
        """Digest of all components by part, entry and place, as decimals joined by commas."""
        return hashlib.sha256(",".join(map(str, self.by_length[length].ravel().tolist())).encode()).hexdigest()


def trie_runs(parts: np.ndarray, entries: np.ndarray, leaves: int = LEAVES) -> Iterator[tuple[int, np.ndarray]]:
    """Depth-first distances of sorted distinct ``parts`` (a row each) to ``entries``: first leaf and a row a leaf.

    ``parts`` in lexicographic order are the leaves in the order of a depth-first visit, and a leaf's path differs
    from the last one's only below their common prefix. Only nodes below it get new vectors.
    """
    n, width = parts.shape
    path = [np.zeros((1, len(entries)), np.int64)] + [None] * width
    for first in range(0, n, leaves):
        run = parts[first:first + leaves]
        before = parts[first - 1:first - 1 + len(run)] if first else np.vstack([run[:1], run[:-1]])
        differs = run != before
        if not first:
            differs[0] = True
        level, node = path[0], np.zeros(len(run), np.int64)
        for k in range(width):
            fresh = differs[:, :k + 1].any(1)
            own = level[node[fresh]] + (run[fresh, k][:, None] - entries[None, :, k]) ** 2
            carried = path[k + 1] is not None
            node = np.cumsum(fresh) - (0 if carried else 1)
            level = np.vstack([path[k + 1], own]) if carried else own
            path[k + 1] = level[node[-1]][None]
        yield first, level[node]


def coded(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes and errors (row, part) of ``vectors`` (row, part, component), with weighted sums and counts of entries."""
    n, parts, width = vectors.shape
    code, error = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64)
    sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    for p in range(parts):
        x = vectors[:, p]
        order = np.lexsort(x.T[::-1])
        new = np.ones(n, bool)
        new[1:] = (x[order[1:]] != x[order[:-1]]).any(1)
        leaf = np.empty(n, np.int64)
        leaf[order] = np.cumsum(new) - 1
        leaves = x[order[new]]
        weight = np.bincount(leaf, minlength=len(leaves))
        best, least = np.empty(len(leaves), np.int64), np.empty(len(leaves), np.int64)
        for first, distance in trie_runs(leaves, books[p]):
            b = distance.argmin(1)
            best[first:first + len(b)], least[first:first + len(b)] = b, distance[np.arange(len(b)), b]
        np.add.at(sums[p], best, leaves * weight[:, None])
        np.add.at(counts[p], best, weight)
        code[:, p], error[:, p] = best[leaf], least[leaf]
    return code, error, sums, counts


def whole_numbers(vectors: DataFrame, parts: int = 16, id_col: str = "vec_id", vector: str = "embedding",
                  label: str | None = "label", scale: float = 256.0) -> DataFrame:
    """id, label, length and q (whole components, filled up to a multiple of ``parts``) of the usable vectors, saved."""
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), x * scale))).cast("int"))
    lack = F.greatest(F.lit(parts), F.ceil(F.size(v) / parts) * parts).cast("int") - F.size(v)
    q = F.concat(whole, F.array_repeat(F.lit(0), lack))
    return saved(vectors.where(F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).alias("id"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"),
        F.size(v).alias("length"), q.alias("q")))


def first_entries(whole: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the ``entries`` first vectors of each length: bounded by entries times the number of lengths."""
    order = Window.partitionBy("length").orderBy(F.asc_nulls_last("id"), "q")
    rows = whole.select("length", "id", "q").withColumn("n", F.row_number().over(order)).where(F.col("n") <= entries)
    books: dict[int, list] = {}
    for r in sorted(rows.collect(), key=lambda r: r["n"]):
        held = books.setdefault(r["length"], [])
        if r["id"] is not None or not held or held[0][0] is None:
            held.append((r["id"], r["q"]))
    return Codebooks({length: np.array([q for _, q in held], np.int64).reshape(len(held), parts, -1).swapaxes(0, 1)
                      for length, held in books.items()})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of up to BLOCK_ROWS rows (one batch more at most)."""
    kept, n = [], 0
    for b in batches:
        kept.append(b)
        n += b.num_rows
        if n >= BLOCK_ROWS:
            yield pa.Table.from_batches(kept)
            kept, n = [], 0
    if n:
        yield pa.Table.from_batches(kept)


def _by_length(table: pa.Table, books: Codebooks) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each vector length: its rows and their parts."""
    lengths = table.column("length").to_numpy()
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        q = table.column("q").take(pa.array(at)).combine_chunks().flatten().to_numpy()
        yield length, at, q.astype(np.int64).reshape(len(at), books.by_length[length].shape[0], -1)


def refined(whole: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round: entries at the floored mean of their parts, unused ones as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for table in _blocks(batches):
            for length, _, x in _by_length(table, books):
                _, _, sums, counts = coded(x, books.by_length[length])
                s, c = total.get(length, (0, 0))
                total[length] = (s + sums, c + counts)
        for length, (s, c) in total.items():
            p, e = np.nonzero(c)
            yield pa.RecordBatch.from_pydict({
                "length": np.full(len(p), length, np.int32), "part": p.astype(np.int32), "entry": e.astype(np.int32),
                "n": c[p, e], "sums": pa.array(list(s[p, e]), pa.list_(pa.int64()))})

    found = whole.select("length", "q").mapInArrow(run, "length int, part int, entry int, n long, sums array<long>")
    place = found.select("length", "part", "entry", "n", F.posexplode("sums").alias("k", "v"))
    means = place.groupBy("length", "part", "entry", "k").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    out = {length: b.copy() for length, b in books.by_length.items()}
    # parts x entries x width rows a length
    for r in means.toLocalIterator():
        out[r["length"]][r["part"], r["entry"], r["k"]] = int(r["s"]) // r["n"]
    return Codebooks(out)


def fit_codebooks(whole: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks:
    """Codebooks of a table made by ``whole_numbers``."""
    books = first_entries(whole, parts, entries)
    for _ in range(rounds):
        books = refined(whole, books)
    return books


def encoded(whole: DataFrame, books: Codebooks) -> DataFrame:
    """id, label, length, codes (array of entry numbers) and error of each vector."""
    schema = whole.select("id", "label", "length").schema.add("codes", T.ArrayType(T.IntegerType())).add(
        "errors", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            for length, at, x in _by_length(table, books):
                code, error, _, _ = coded(x, books.by_length[length])
                rest = table.select(["id", "label", "length"]).take(pa.array(at)).combine_chunks()
                ends = np.arange(0, code.size + 1, code.shape[1], dtype=np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in (code.astype(np.int32), error)]
                yield pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in rest.columns], *lists], schema=None,
                                                 names=["id", "label", "length", "codes", "errors"])

    total = F.aggregate("errors", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))
    return whole.mapInArrow(run, schema).withColumn("errors", _held(total)).withColumnRenamed("errors", "error")


def _held(x: Column) -> Column:
    return F.least(x, F.lit(MOST).cast("decimal(38,0)")).cast("long")


def decoded(codes: DataFrame, books: Codebooks, scale: float = 256.0) -> DataFrame:
    """``codes`` (of ``encoded``) with ``vector``: the entries' components in place of the vector's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for length, c in zip(column(b, "length").to_pylist(), column(b, "codes").to_pylist()):
                book = books.by_length[length]
                out.append((book[np.arange(len(c)), c].ravel()[:length] / scale))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], names=[*b.schema.names, "vector"])

    return codes.mapInArrow(run, codes.select("*").schema.add("vector", T.ArrayType(T.DoubleType())))


def with_label_error(codes: DataFrame, salts: int = 16) -> DataFrame:
    """``codes`` (a saved table) with label_error, the errors of equal labels together (null labels are equal).

    Sums are made before the shuffle. They are broadcast where they are few; else they meet their rows salted, since
    one label may hold a third of all rows.
    """
    sums = codes.groupBy(F.col("label").alias("_l")).agg(_held(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"))
    sums = sums.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64("id", "codes"), F.lit(salts)).cast("int")
    return codes.withColumn("_r", salt).join(
        broadcast_if_small(sums), F.col("label").eqNullSafe(F.col("_l")) & (F.col("_r") == F.col("_s"))).drop("_l", "_s", "_r")


def compressed(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id",
               vector: str = "embedding", label: str | None = "label") -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and codebooks_sha256 of all usable vectors."""
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits hold 256 entries at most")
    whole = whole_numbers(vectors, parts, id_col, vector, label)
    books = fit_codebooks(whole, parts, entries, rounds)
    rows = with_label_error(saved(encoded(whole, books)))
    digests = F.create_map(*[F.lit(x) for n in books.by_length for x in (n, books.sha256(n))]) if books.by_length else F.lit(None).cast("map<int,string>")
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return rows.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error",
                       F.try_element_at(digests, F.col("length")).alias("codebooks_sha256"))
