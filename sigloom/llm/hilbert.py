"""Sharding along a Hilbert curve over several metadata dimensions, in DataFrame expressions throughout.

Each dimension is quantised into 2^bits cells that hold about equally many rows; its cell edges come from a histogram
of its values, so any orderable type will do. The cells of one row are a point of a grid, and the point's place on
the grid's Hilbert curve is its curve index. Rows sorted by it are cut into runs: a run covers a compact part of the
grid, so its smallest and largest value in every dimension are close, and a filter on any of the dimensions leaves
few runs to read (``run_ranges``, ``runs_for``).

Two laws of cutting: ``rows`` (numbers of rows are at most one apart) and ``bytes`` (a run ends where the running sum of
sizes comes nearest to its share, so sizes differ from their mean by one row's size at most).

Rows of one cell are told apart by their tie-breakers and at last by their place in the input, so a curve index that a
third of all rows share is split over many sort partitions; running sums are carried from partition to partition.
Texts are read once and never shuffled: only keys, sizes and dimensions are.

Defined cases: a null is in the first cell of its dimension; a dimension with one value has one cell; null and empty
texts have no bytes. Rows that repeat are rows of their own. Extra columns stay as they are whatever their names;
columns that the plan adds come in their place where the names clash. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.scan import prefix_sum
from sigloom.llm.common import saved

PLAN = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve"]


def curve_steps(n: int) -> list[int]:
    """One step down the curve of ``n`` dimensions: for (state, quadrant) the next state and the place in it.

    A state is the corner where the sub-cube's curve enters and the direction in which it leaves. The quadrant is
    seen in that frame, and its Gray code rank is its place; corner and direction of the sub-cube follow from the rank.
    """
    def turned(v: int, by: int) -> int:
        by %= n
        return ((v << by) | (v >> (n - by))) & ((1 << n) - 1)

    def rank_of(gray: int) -> int:
        r = 0
        while gray:
            r, gray = r ^ gray, gray >> 1
        return r

    def ones_below(v: int) -> int:
        return (~v & (v + 1)).bit_length() - 1

    out = []
    for state in range(n << n):
        corner, way = divmod(state, n)
        for quadrant in range(1 << n):
            w = rank_of(turned(quadrant ^ corner, -(way + 1)))
            even = max(0, w - 1) // 2 * 2
            at = corner ^ turned(even ^ (even >> 1), way + 1)
            leaves = 0 if w == 0 else ones_below(w if w % 2 else w - 1)
            out.append((at * n + (way + leaves + 1) % n) << n | w)
    return out


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a grid point whose coordinates have ``bits`` bits each."""
    n = len(cells)
    if n == 1:
        return cells[0].cast("long")
    if n * bits > 62:
        raise ValueError("at most 62 bits for all dimensions together")
    steps = F.array(*[F.lit(s) for s in curve_steps(n)])

    def step(acc: Column, level: Column) -> Column:
        quadrant = reduce(lambda a, b: a + b, [
            F.getbit(c.cast("long"), level).cast("int") * (1 << k) for k, c in enumerate(cells)])
        move = F.get(steps, acc["state"] * (1 << n) + quadrant)
        return F.struct((acc["at"] * (1 << n) + move.bitwiseAND((1 << n) - 1)).cast("long").alias("at"),
                        F.shiftright(move, n).cast("int").alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("state"))
    return F.aggregate(F.array(*[F.lit(b) for b in reversed(range(bits))]), start, step, lambda acc: acc["at"])


def cell_edges(rows: DataFrame, dim: str, bits: int) -> list:
    """First value of each cell but the first: at most 2^bits - 1 values, of cells with about equally many rows."""
    known = rows.where(F.col(dim).isNotNull())
    hist = known.groupBy(F.col(dim).alias("v")).agg(F.count("*").alias("n"))
    total = known.count()
    run = prefix_sum(hist, [F.col("v")], {"upto": F.col("n")})
    cell = F.floor((F.col("upto") - F.col("n")) * (1 << bits) / F.lit(max(total, 1))).cast("int")
    first = run.groupBy(cell.alias("cell")).agg(F.min("v").alias("v")).collect()
    return [r["v"] for r in sorted(first, key=lambda r: r["cell"])][1:]


def cell_of(value: Column, edges: list) -> Column:
    """Cell of a value: how many edges it has reached (a null: none)."""
    return reduce(lambda a, b: a + b, [F.coalesce((value >= F.lit(e)).cast("int"), F.lit(0)) for e in edges], F.lit(0))


def cut(rows: DataFrame, dims: tuple[str, ...], order: tuple[str, ...], shards: int = 8, law: str = "rows", bits: int = 5) -> DataFrame:
    """``rows`` (a saved table with ``size``) with curve, shard and slot (place in its shard from 0, in curve order)."""
    if law not in ("rows", "bytes"):
        raise ValueError(law)
    cells = [cell_of(F.col(d), cell_edges(rows, d, bits)) for d in dims]
    placed = rows.withColumn("curve", hilbert_index(cells, bits)).withColumn("_at", F.monotonically_increasing_id())
    keys = [F.col("curve"), *[F.asc_nulls_first(c) for c in order], F.col("_at")]
    run = prefix_sum(placed, keys, {"_n": F.lit(1).cast("long"), "_sum": F.col("size")})
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    n, size = max(total["n"], 1), max(total["size"] or 0, 1)
    if law == "rows":
        shard = F.expr(f"(_n - 1) * {shards} div {n}")
        slot = F.col("_n") - 1 - F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
        out = run.withColumn("shard", shard.cast("int")).withColumn("slot", slot)
    else:
        # the middle of a row decides, in halves of a byte
        middle = (2 * F.col("_sum") - F.col("size")).cast("decimal(38,0)") * shards / F.lit(2 * size)
        run = run.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle)).cast("int"))
        first = run.groupBy(F.col("shard").alias("_s")).agg(F.min("_n").alias("_first"))  # one row a shard
        out = run.join(F.broadcast(first), F.col("shard") == F.col("_s")).withColumn("slot", F.col("_n") - F.col("_first"))
        out = out.drop("_s", "_first")
    return out.drop("_n", "_sum", "_at")


def plan(docs: DataFrame, dims: tuple[str, ...] = ("source", "lang", "n_chars"), shards: int = 8, law: str = "bytes",
         bits: int = 5) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: neither law knows it) and curve of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = saved(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                             F.crc32(text.cast("binary")).alias("text_crc32"), *[F.col(d).alias(f"_d{k}") for k, d in enumerate(dims)]))
    out = cut(slim, tuple(f"_d{k}" for k in range(len(dims))), ("doc_id", "text_crc32", "size"), shards, law, bits)
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "curve")


def sharded(docs: DataFrame, dims: tuple[str, ...] = ("source", "lang", "n_chars"), shards: int = 8, law: str = "bytes",
            bits: int = 5) -> DataFrame:
    """``docs`` with shard, slot and curve; whole rows go through the sort."""
    rest = [c for c in docs.columns if c not in ("shard", "slot", "curve")]
    rows = saved(docs.select(F.struct(*rest).alias("_row"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
                             "doc_id", *[F.col(d).alias(f"_d{k}") for k, d in enumerate(dims)]))
    out = cut(rows, tuple(f"_d{k}" for k in range(len(dims))), ("doc_id", "size"), shards, law, bits)
    return out.select("_row.*", "shard", "slot", "curve")


def write_shards(rows: DataFrame, path: str) -> None:
    """``rows`` of ``sharded`` as Parquet, a folder for each shard, in curve order."""
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def run_ranges(rows: DataFrame, dims: tuple[str, ...], run: str = "shard") -> DataFrame:
    """For each run: rows, and the smallest, the largest and the number of nulls of each dimension."""
    parts = [F.count("*").alias("rows")]
    for d in dims:
        parts += [F.min(d).alias(f"min_{d}"), F.max(d).alias(f"max_{d}"), F.count_if(F.col(d).isNull()).alias(f"nulls_{d}")]
    return rows.groupBy(run).agg(*parts)


def runs_for(ranges: DataFrame, wanted: dict[str, tuple]) -> DataFrame:
    """The runs of ``run_ranges`` that can hold rows within all ``wanted`` ranges (dimension: lowest and highest value)."""
    for d, (low, high) in wanted.items():
        ranges = ranges.where((F.col(f"max_{d}") >= F.lit(low)) & (F.col(f"min_{d}") <= F.lit(high)))
    return ranges
