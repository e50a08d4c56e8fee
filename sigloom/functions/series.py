"""Rolling, lagged and recursive columns of one symbol's bars as numpy arrays, and the Arrow group that brings them there.

The same frames as in ``functions.windows``, for steps that need many of them at once: a sliding frame of Spark's visits
each of its rows again for each bar, while here a frame of n rows is put together from frames of 1, 2, 4, ... rows, so
that a bar costs log2(n) vector additions and only values of the frame itself enter it. Nan stands for a missing value.

Bound: one symbol's bars, and the rows of other tables that are laid beside them, are one Arrow group, as long as the calendar.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions.windows import BLOCK, OHLCV

Columns = dict[str, np.ndarray]
# Column of the rows beside the bars: kind and numbers of each.
BESIDE = "_beside"
ARROW = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(),
         "array<double>": pa.list_(pa.float64()), "array<array<float>>": pa.list_(pa.list_(pa.float32()))}


def lag(x: np.ndarray, k: int = 1) -> np.ndarray:
    out = np.full(len(x), np.nan)
    out[k:] = x[:len(x) - k] if k < len(x) else x[:0]
    return out


def lead(x: np.ndarray, k: int = 1) -> np.ndarray:
    return lag(x[::-1], k)[::-1]


def div(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a/b, missing where b is 0."""
    with np.errstate(all="ignore"):
        return np.where(b == 0, np.nan, a / b)


def known(x: np.ndarray, value: float = 0.0) -> np.ndarray:
    return np.where(np.isnan(x), value, x)


def filled(x: np.ndarray) -> np.ndarray:
    """Each missing value replaced by the last one before it."""
    at = np.maximum.accumulate(np.where(np.isnan(x), -1, np.arange(len(x))))
    return np.where(at >= 0, x[np.maximum(at, 0)], np.nan)


def _shifted(x: np.ndarray, k: int, none: float) -> np.ndarray:
    out = np.full(len(x), none)
    if k < len(x):
        out[k:] = x[:len(x) - k]
    return out


def _extreme(pick: np.ufunc, x: np.ndarray, n: int, none: float) -> np.ndarray:
    k = 1
    while 2 * k <= n:
        x, k = pick(x, _shifted(x, k, none)), 2 * k
    return pick(x, _shifted(x, n - k, none)) if n > k else x


def _total(x: np.ndarray, n: int) -> np.ndarray:
    out, at, k = np.zeros(len(x)), 0, 1
    while True:
        if n & k:
            out, at = out + _shifted(x, at, 0.0), at + k
        if 2 * k > n:
            return out
        x, k = x + _shifted(x, k, 0.0), 2 * k


def roll(kind: str, x: np.ndarray, n: int, m: int | None = None) -> np.ndarray:
    """max, min, sum, mean or std of the last ``n`` rows, missing until ``m`` (default ``n``) of them have a value."""
    none = np.isnan(x)
    upto = np.cumsum(~none)
    count = upto - np.concatenate([np.zeros(min(n, len(x)), upto.dtype), upto[:max(len(x) - n, 0)]])
    enough = count >= (n if m is None else m)
    if kind == "max":
        y = _extreme(np.maximum, np.where(none, -np.inf, x), n, -np.inf)
    elif kind == "min":
        y = _extreme(np.minimum, np.where(none, np.inf, x), n, np.inf)
    elif kind == "std":
        y = np.sqrt(cov(x, x, n))
    else:
        x = np.where(none, 0.0, x)
        # frames that still reach the first row are one sum for every n, so that equal frames give equal averages
        y = np.where(np.arange(len(x)) < n, np.cumsum(x), _total(x, n))
        if kind == "mean":
            y = y / np.maximum(count, 1)
    return np.where(enough, y, np.nan)


def prior(kind: str, x: np.ndarray, n: int) -> np.ndarray:
    """The same over the ``n`` rows before this one."""
    return lag(roll(kind, x, n))


def _centred(x: np.ndarray, frames: np.ndarray, n: int, kept: dict) -> np.ndarray:
    key = id(x), n
    if key not in kept:
        kept[key] = x, frames - frames.mean(axis=1, keepdims=True)  # with the column, so that its id stays its own
    return kept[key][1]


def cov(x: np.ndarray, y: np.ndarray, n: int, centred: dict | None = None) -> np.ndarray:
    """Sample covariance of the last ``n`` rows without pairs that lack a value; exactly 0 for equal values, missing before row n.

    ``centred`` keeps the frames of whole columns less their means, for calls with the same columns.
    """
    out = np.full(len(x), np.nan)
    if len(x) < n:
        return out
    none = np.isnan(x) | np.isnan(y)
    a, b = sliding_window_view(x, n), sliding_window_view(y, n)
    if none.any():
        w = sliding_window_view(~none, n)
        count = w.sum(axis=1)
        a, b = np.where(w, a, 0.0), np.where(w, b, 0.0)
        a = np.where(w, a - a.sum(axis=1, keepdims=True) / np.maximum(count, 1)[:, None], 0.0)
        b = np.where(w, b - b.sum(axis=1, keepdims=True) / np.maximum(count, 1)[:, None], 0.0)
    else:
        count = np.full(len(a), n)
        centred = {} if centred is None else centred
        a, b = (_centred(z, w, n, centred) for z, w in ((x, a), (y, b)))
    s = np.einsum("ij,ij->i", a, b)
    out[n - 1:] = np.where(count > 1, s / np.maximum(count - 1, 1), np.nan)
    if x is y:
        top, low = _extreme(np.fmax, x, n, np.nan), _extreme(np.fmin, x, n, np.nan)
        out[n - 1:][(top == low)[n - 1:] & (count > 1)] = 0.0
    return out


@cache
def _powers(q: float) -> tuple[np.ndarray, np.ndarray]:
    """q^-j and q^j of a block's rows by the C library, whatever vector unit the machine has."""
    return np.array([q ** -j for j in range(BLOCK)]), np.array([q ** j for j in range(BLOCK + 1)])


def ewm(x: np.ndarray, alpha: float, first: int, adjust: bool = False) -> np.ndarray:
    """Recursive average from row ``first`` on: a sum of x q^-j in each block of 512 rows, and the end of the block before."""
    out = np.full(len(x), np.nan)
    x, q = known(x[first:]), 1.0 - alpha
    down, up = _powers(q)
    before = 0.0
    for lo in range(0, len(x), BLOCK):
        part = x[lo:lo + BLOCK]
        u = part if adjust else part * alpha
        if lo == 0 and not adjust:
            u[0] = part[0]
        y = np.cumsum(u * down[:len(part)]) * up[:len(part)] + before * up[1:len(part) + 1]
        before = y[-1]
        out[first + lo:first + lo + len(part)] = y
    if adjust:
        out[first:] *= alpha / (1.0 - np.power(q, np.arange(len(x)) + 1.0))
    return out


def _typed(x, kind: str) -> pa.Array:
    if isinstance(x, (pa.Array, pa.ChunkedArray)):
        return x
    if kind == "double":
        return pa.array(np.asarray(x, dtype=float), pa.float64(), from_pandas=True)
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    if x.dtype.kind == "f":  # a flag of the row before: missing on the first
        none = np.isnan(x)
        return pa.array(np.where(none, 0, x).astype(kinds[kind].to_pandas_dtype()), kinds[kind], mask=none)
    return pa.array(x.astype(kinds[kind].to_pandas_dtype()), kinds[kind])


def _beside(side: pa.ChunkedArray) -> dict[int, np.ndarray]:
    """kind -> rows of numbers; all lists of one kind have one length."""
    lists = side.combine_chunks()
    at, x = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    start, size = at[:-1], np.diff(at)
    kinds = x[start].astype(int)
    return {int(k): x[start[kinds == k][:, None] + np.arange(1, size[kinds == k][0])] for k in np.unique(kinds)}


def per_symbol(bars: DataFrame, step: Callable[[Columns], Columns], given: list[str], made: dict[str, str], fill: bool = True,
               beside: DataFrame | None = None, dealt: bool = False, copies: tuple[str, Callable] | None = None) -> DataFrame:
    """``given`` columns of ``bars`` (a row per sym and dt) and those that ``step`` makes (name -> type), in one exchange on sym.

    ``step`` gets the numeric columns in the order of dt, prices and volume filled forward, and ``_i``: 0 at the first bar
    with a close. A type of "array..." takes a pyarrow array. Where ``step`` also makes ``_asked``, only those rows are returned.
    Besides, it gets ``_raw`` (prices and volume as they are) and ``_day`` (days since 1970, where dt is a date).

    ``beside`` has rows of other tables: sym and ``BESIDE``, an array of a kind and numbers; ``step`` gets them by kind,
    without an order. ``dealt`` bars come dealt by sym and are not exchanged again. ``copies`` is (column, function): the
    function makes (name, columns) from a symbol's columns and its sym, ``step`` runs on each, ``column`` has the name.
    """
    fields = {f.name: f.dataType.simpleString() for f in bars.schema.fields}
    prices = [x for x in OHLCV if x in fields]
    bars = bars.withColumns({x: F.col(x).cast("double") for x in prices})
    numeric = [x for x, t in fields.items() if t in ("double", "float", "int", "bigint", "smallint", "boolean") or x in prices]
    numeric = [x for x in numeric if x != "sym"]
    kinds = {**{x: "double" if x in prices else t for x, t in fields.items() if x in given and x not in made}, **made}
    kinds.update({copies[0]: "string"} if copies else {})
    stacked = beside is not None

    def rows(table: pa.Table, b: Columns, name: str | None = None) -> pa.Table:
        got = step(b)
        keep = pa.array(got["_asked"]) if "_asked" in got else None
        cols = {}
        for x, kind in kinds.items():
            if copies and x == copies[0]:
                cols[x] = pa.array([name] * table.num_rows, pa.string())
            else:
                cols[x] = _typed(got[x], kind) if x in made else _typed(b[x], kind) if x in prices else table.column(x)
        out = pa.table(cols)
        return out if keep is None else out.filter(keep)

    def empty(table: pa.Table) -> pa.Table:
        own = set(made) | {copies[0] if copies else ""}
        return pa.table({x: pa.array([], ARROW[kind]) if x in own else table.column(x).slice(0, 0) for x, kind in kinds.items()})

    def run(table: pa.Table) -> pa.Table:
        side = {}
        if stacked:
            none = table.column(BESIDE).is_null()
            side, table = table.filter(pc.invert(none)).column(BESIDE), table.filter(none)
            side = _beside(side) if len(side) and table.num_rows else {}
        table = table.sort_by("dt")
        b = {x: table.column(x).to_numpy().astype(float) for x in numeric}
        b["_raw"] = {x: b[x] for x in prices}
        if fill:
            for x in prices:
                b[x] = filled(b[x])
        if pa.types.is_date32(table.schema.field("dt").type):
            b["_day"] = table.column("dt").cast(pa.int32()).to_numpy()
        if stacked:
            b[BESIDE] = side
        b.setdefault("_i", np.cumsum(~np.isnan(b["close"])) - 1)
        with np.errstate(all="ignore"):
            if not table.num_rows:  # rows beside bars that do not exist
                return empty(table)
            if copies is None:
                return rows(table, b)
            parts = [rows(table, {**b, **c}, name) for name, c in copies[1](b, table.column("sym")[0].as_py())]
        return pa.concat_tables(parts) if parts else empty(table)

    n = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = bars if dealt else bars.repartition(n, "sym")
    if stacked:
        df = df.unionByName(beside.repartition(n, "sym").select("sym", BESIDE), allowMissingColumns=True)
    return df.groupBy("sym").applyInArrow(run, ", ".join(f"`{x}` {kind}" for x, kind in kinds.items()))
