"""Rolling, lagged and recursive columns over one series per ``sym``.

Bound: these windows run on *bar* tables, where ``(sym, dt)`` is unique, so a partition never holds
more rows than the calendar has dates, however many raw rows the symbol had. Raw rows (ticks,
log lines, trades) never come here; they go through ``functions.scan``.

All windows share the partitioning ``sym`` and the order ``(_b, dt)``, where ``_b`` grows with
``dt``: one exchange and one extra local sort serve a whole indicator set, the recursive averages
included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

BLOCK = 512
OHLCV = ("open", "high", "low", "close", "volume")

START = Window.unboundedPreceding


def by_time() -> WindowSpec:
    return Window.partitionBy("sym").orderBy("dt")


def series() -> WindowSpec:
    return Window.partitionBy("sym").orderBy("_b", "dt")


def in_block() -> WindowSpec:
    return Window.partitionBy("sym", "_b").orderBy("dt")


def by_symbol(df: DataFrame) -> DataFrame:
    """The one exchange of a series pipeline, at the session's shuffle width.

    An explicit count keeps adaptive execution from merging partitions by their (small) input
    bytes: the work per input byte is large here.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "sym")


def as_series(bars: DataFrame, fill: bool = True) -> DataFrame:
    """Forward-fill OHLCV and number the rows: ``_i`` from 0 at the first bar with a close
    (negative before it) and ``_b`` = the 512-row block of ``_i``."""
    past = by_time().rowsBetween(START, 0)
    df = by_symbol(bars)
    if fill:
        df = df.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in OHLCV})
    df = df.withColumn("_i", F.sum(F.when(F.col("close").isNotNull(), 1).otherwise(0)).over(past).cast("long") - 1)
    return df.withColumn("_b", F.expr(f"_i div {BLOCK}"))


def index_series(df: DataFrame) -> DataFrame:
    """``_i`` and ``_b`` for a table that has no OHLCV columns to fill."""
    df = df.withColumn("_i", F.row_number().over(by_time()).cast("long") - 1)
    return df.withColumn("_b", F.expr(f"_i div {BLOCK}"))


def last_rows(n: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w or series()).rowsBetween(-(n - 1), 0)


def roll(agg: Callable[[Column], Column], x: Column | str, n: int, m: int | None = None,
         w: WindowSpec | None = None) -> Column:
    """``agg`` over the last ``n`` rows, null until ``m`` (default ``n``) of them have a value.

    A plain frame: a running total would carry rounding noise of every value before it.
    """
    x = F.col(x) if isinstance(x, str) else x
    frame = last_rows(n, w)
    return F.when(F.count(x).over(frame) >= (n if m is None else m), agg(x).over(frame))


def prior(agg: Callable[[Column], Column], x: Column | str, n: int) -> Column:
    """``agg`` over the ``n`` rows before this one, null unless all have a value."""
    x = F.col(x) if isinstance(x, str) else x
    frame = series().rowsBetween(-n, -1)
    return F.when(F.count(x).over(frame) >= n, agg(x).over(frame))


def lag(x: Column | str, k: int = 1) -> Column:
    return F.lag(x, k).over(series())


def running(x: Column | str, w: WindowSpec | None = None) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.sum(F.coalesce(x, F.lit(0.0))).over((w or series()).rowsBetween(START, 0))


def with_ewm(df: DataFrame, specs: dict[str, tuple[Column | str, float, bool]]) -> DataFrame:
    """Add recursive averages ``out = (input, alpha, adjust)`` by windows alone.

    y_i = (1-a) y_{i-1} + a x_i unrolls to a weighted sum. Inside a 512-row block it is one
    running sum of x·q^-j scaled back by q^j (q = 1-a), which stays in double range for spans
    of 3 and more. The value carried in from before the block is the last block's end plus the
    block before that; older rows weigh q^1024, under 2e-15 up to span 60.
    ``adjust`` divides by the geometric sum of the weights, as an adjusted average does.
    Rows before the first complete bar get null.
    """
    for _, (_, a, _adj) in specs.items():
        if not (2.0 / 61.0 - 1e-12 <= a <= 0.5):
            raise ValueError("alpha outside the range the block length is exact for")
    names = list(specs)
    j = F.col("_i") % BLOCK
    i = F.col("_i")
    closes_block = j == BLOCK - 1
    before = series().rowsBetween(START, -1)

    local = {}
    for n in names:
        x, a, adj = specs[n]
        x = F.col(x) if isinstance(x, str) else x
        q = 1.0 - a
        u = x if adj else F.when(i == 0, x).otherwise(x * F.lit(a))
        u = F.when(i >= 0, u * F.pow(F.lit(1.0 / q), j))
        local[f"_l_{n}"] = F.sum(u).over(in_block().rowsBetween(START, 0)) * F.pow(F.lit(q), j)
    df = df.withColumns(local)
    df = df.withColumns({
        f"_p_{n}": F.last(F.when(closes_block, F.col(f"_l_{n}")), ignorenulls=True).over(before)
        for n in names
    })
    carried = {}
    for n in names:
        q = 1.0 - specs[n][1]
        two = F.col(f"_l_{n}") + F.coalesce(F.col(f"_p_{n}"), F.lit(0.0)) * F.lit(q**BLOCK)
        carried[f"_c_{n}"] = F.last(F.when(closes_block, two), ignorenulls=True).over(before)
    df = df.withColumns(carried)
    out = {}
    for n in names:
        _, a, adj = specs[n]
        q = 1.0 - a
        y = F.col(f"_l_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0.0)) * F.pow(F.lit(q), j + 1)
        if adj:
            y = y * F.lit(a) / (F.lit(1.0) - F.pow(F.lit(q), i + 1))
        out[n] = F.when(i >= 0, y)
    df = df.withColumns(out)
    return df.drop(*[f"{p}{n}" for n in names for p in ("_l_", "_p_", "_c_")])


def span(n: int) -> float:
    return 2.0 / (n + 1.0)
