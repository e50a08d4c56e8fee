"""The 60 x 49 sequence of each bar, and scoring of sequences by a caller's model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.scalar import EPS
from sigloom.functions.series import Columns, div, lag, per_symbol
from sigloom.operators.indicators import indicator_columns

ROWS, WIDTH = 60, 49


def bar_matrix(b: Columns, made: Columns | None = None) -> np.ndarray:
    """The 49 normalised values of each bar, in index order, as floats; missing ones are 0, infinities +/-5.

    ``made`` are the bars' ``indicator_columns``, where a caller has them.
    """
    f = {**b, **{k: x.astype(float) for k, x in (made or indicator_columns(b)).items()}}
    c = f["close"] + EPS

    def rel(x: str) -> np.ndarray:
        return f[x] / c - 1.0

    def change(x: str) -> np.ndarray:
        prev = lag(f[x])
        return np.where(prev == 0, np.where(f[x] == 0, np.nan, np.inf), div(f[x], prev) - 1)

    def over(x: str, y: str) -> np.ndarray:
        return div(f[x], f[y] + EPS)

    cols = [
        f["RSI"] / 100.0, f["MACD"] / c, f["Signal_Line"] / c, f["ATR"] / c, (f["KC_Upper"] - f["KC_Lower"]) / c,
        (f["BB_Upper"] - f["BB_Lower"]) / c, rel("Tenkan"), rel("Kijun"), rel("SenkouA"), rel("SenkouB"), f["SuperTrend_Up"],
        f["CMF"], f["Range"] / c, f["NR7"], f["Inside_Bar"], f["VPT_ZScore"], f["VPT_Accel"], rel("VWAP_20"), rel("AVWAP"),
        over("volume", "Max_Down_Vol_10"), rel("OB_High"), rel("OB_Low"), rel("Swing_Low_20"), f["Range_60"] / c,
        f["Range_20"] / c, rel("Price_High_20"), over("volume", "Vol_MA20"), f["CVD_Trend"], f["CVD_Divergence"],
        rel("Highest_22"), f["ATR_22"] / c, rel("Chandelier_Exit"), f["Smart_Money_Flow"], f["Recent_Price_Surge_3d"] / 100.0,
        f["Recent_Vol_Surge_3d"], f["Amihud"], f["Dist_52W_High"], *[over("close", x) - 1.0 for x in ("SMA_50", "SMA_150", "SMA_200")],
        over("close", "EMA_20") - 1.0, over("close", "EMA_50") - 1.0, f["Above_Cloud"], rel("open"), rel("high"), rel("low"),
        change("close"), change("volume"), div(f["close"] - f["open"], f["high"] - f["low"] + EPS),
    ]
    x = np.nan_to_num(np.stack(cols), copy=False, nan=0.0, posinf=5.0, neginf=-5.0)
    return np.ascontiguousarray(x.astype(np.float32).T)


def sequences(b: Columns, run_rows: int = 64, made: Columns | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of bars with 60 bars up to them and their n x 60 x 49 sequences, ``run_rows`` at once; ``_asked`` limits the bars."""
    asked = np.flatnonzero(b["_asked"] == 1) if "_asked" in b else np.arange(len(b["close"]))
    asked = asked[asked >= ROWS - 1]
    if not len(asked):
        return
    matrix, back = bar_matrix(b, made), np.arange(1 - ROWS, 1)
    for lo in range(0, len(asked), run_rows):
        at = asked[lo:lo + run_rows]
        part = np.take(matrix, at[:, None] + back, axis=0)
        part[:, 0, 46:48] = 0  # the oldest row has no row before it inside the slice
        yield at, part


def _marked(bars: DataFrame, asked: DataFrame | None) -> DataFrame:
    if asked is None:
        return bars
    return bars.join(asked.select("sym", "dt", F.lit(1).alias("_asked")), ["sym", "dt"], "left")


def sequence_tensor(bars: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """sym, dt, seq ARRAY<ARRAY<FLOAT>>: the 60 bars up to each bar, oldest first. Bars with less
    history get 60 rows of zeros. The two change columns of the oldest row are 0, as it has no row
    before it inside the slice.

    ``asked`` (distinct sym, dt) limits the rows that are built: a tensor is 12 kB.
    """
    def step(b: Columns) -> dict[str, pa.Array]:
        size = ROWS * WIDTH
        at = np.flatnonzero(b["_asked"] == 1) if "_asked" in b else np.arange(len(b["close"]))
        place = np.full(len(b["close"]), -1)
        place[at] = np.arange(len(at))
        flat = np.zeros((len(at), size), np.float32)
        for rows, part in sequences(b):
            flat[place[rows]] = part.reshape(len(rows), size)
        inner = pa.ListArray.from_arrays(pa.array(np.arange(len(at) * ROWS + 1, dtype=np.int32) * WIDTH), pa.array(flat.reshape(-1)))
        ends = np.concatenate([[0], np.cumsum(place >= 0)]).astype(np.int32) * ROWS
        seq = pa.ListArray.from_arrays(pa.array(ends), inner)
        return {"seq": pc.if_else(pa.array(place >= 0), seq, pa.scalar(None, seq.type))}

    out = per_symbol(_marked(bars, asked), step, ["sym", "dt"], {"seq": "array<array<float>>"})
    return out if asked is None else out.where(F.col("seq").isNotNull())


@dataclass(frozen=True)
class SequenceModel:
    """A versioned model: the mean over a sequence's 60 rows, times ``weights`` (49 x 16)."""

    version: int
    weights: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x.mean(axis=1, dtype=np.float64) @ self.weights

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the table at ``path``."""
        row = [(self.version, self.weights.astype(float).tolist())]
        spark.createDataFrame(row, "version int, weights array<array<double>>").coalesce(1).write.mode("append").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SequenceModel:
        """A version of the table at ``path``, the newest by default. It travels to the executors with the task."""
        t = spark.read.parquet(path)
        if version is not None:
            t = t.where(F.col("version") == version)
        row = t.orderBy(F.desc("version")).first()
        if row is None:
            raise LookupError(f"no model version {version or ''} at {path}")
        return cls(row["version"], np.array(row["weights"]))


def model_vectors(b: Columns, model: Callable[[np.ndarray], np.ndarray], width: int = 16, run_rows: int = 64,
                  made: Columns | None = None) -> pa.Array:
    """``model`` of the sequence of each bar of one symbol, a list of ``width`` numbers each."""
    y = np.zeros((len(b["close"]), width))
    y[:ROWS - 1] = model(np.zeros((1, ROWS, WIDTH), np.float32))
    for at, part in sequences(b, run_rows, made):
        y[at] = model(part)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * width), pa.array(y.reshape(-1)))


def score_sequences(bars: DataFrame, model: Callable[[np.ndarray], np.ndarray], width: int = 16, run_rows: int = 64) -> DataFrame:
    """sym, dt, vec: ``model(n x 60 x 49) -> n x width`` for the sequence of every bar.

    One symbol is one Arrow group of 49 numbers a bar (a series is bounded by the calendar); sequences are windows of it
    and only ``run_rows`` of them are laid out at once.
    """
    def step(b: Columns) -> dict[str, pa.Array]:
        return {"vec": model_vectors(b, model, width, run_rows)}

    return per_symbol(bars, step, ["sym", "dt"], {"vec": "array<double>"})


__all__ = ["SequenceModel", "bar_matrix", "model_vectors", "score_sequences", "sequence_tensor"]
