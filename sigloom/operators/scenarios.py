"""Perturbed copies of the bars pushed through the same scoring, and the robustness verdict."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions.scalar import EPS
from sigloom.functions.series import Columns, div, ewm, lead
from sigloom.functions.windows import index_series, span, with_ewm
from sigloom.operators.factors import ALT_DEFAULTS
from sigloom.operators.features import PERIODS, period_columns, vrp
from sigloom.operators.scoring import score_panel
from sigloom.params import Params
from sigloom.plans.panel import series_features
from sigloom.session import materialise

SCENARIOS = ("Original", "Phase_Chaos", "Noise_Explosion")
PRICES = ("open", "high", "low", "close")


def decompose(bars: DataFrame) -> DataFrame:
    """close = trend (EMA60) + seasonal (EMA5 - EMA60) + residual (close - EMA5)."""
    df = with_ewm(index_series(bars), {"e5": ("close", span(5), False), "trend": ("close", span(60), False)})
    return df.withColumns({"seasonal": F.col("e5") - F.col("trend"),
                           "residual": F.col("close") - F.col("e5")}).drop("e5", "_i", "_b")


def _rescaled(df: DataFrame, close) -> DataFrame:
    """The bar moved to a new close, the other prices by the same ratio."""
    ratio = close / (F.col("close") + EPS)
    cols = [(close if c == "close" else F.col(c) * ratio).alias(c) for c in PRICES]
    return df.select("sym", "dt", *cols, "volume")


def noise_scenario(bars: DataFrame, gain: float = 1.5) -> DataFrame:
    return _rescaled(decompose(bars), F.col("trend") + F.col("seasonal") + F.col("residual") * gain)


def phases(sym: str, n: int) -> np.ndarray:
    """Turns in radians of the first ``n`` frequencies of a symbol: keyed hashes, so that any engine gets the same."""
    return np.array([int(hashlib.md5(f"{sym}|{k}".encode()).hexdigest()[:8], 16) for k in range(n)]) * (2 * np.pi / (1 << 32))


def phase_scenario(bars: DataFrame) -> DataFrame:
    """Random phases on the seasonal spectrum; first and (even length) last bin keep theirs.

    A whole-series transform, so one Arrow group per symbol: at most one row per calendar date.
    """
    parts = decompose(bars).select("sym", "dt", *PRICES, "volume", "trend", "seasonal", "residual")

    def shift(table: pa.Table) -> pa.Table:
        table = table.sort_by("dt")
        x = table.column("seasonal").to_numpy()
        spec = np.fft.rfft(x)
        turn = phases(str(table.column("sym")[0].as_py()), len(spec))
        turn[0] = 0.0
        if len(x) % 2 == 0:
            turn[-1] = 0.0
        moved = np.fft.irfft(spec * np.exp(1j * turn), n=len(x))
        return table.set_column(table.schema.get_field_index("seasonal"), "seasonal", pa.array(moved))

    moved = parts.groupBy("sym").applyInArrow(shift, parts.schema)
    return _rescaled(moved, F.col("trend") + F.col("seasonal") + F.col("residual"))


def scenario_columns(b: Columns, sym: object, min_bars: int = 500, gain: float = 1.5) -> list[tuple[str, Columns]]:
    """The prices of one symbol's scenarios, as ``phase_scenario`` and ``noise_scenario`` make them; none without enough history."""
    close = b["close"]
    if len(close) < min_bars:
        return []
    fast, trend = ewm(close, span(5), 0), ewm(close, span(60), 0)
    seasonal, residual = fast - trend, close - fast
    spec = np.fft.rfft(seasonal)
    turn = phases(str(sym), len(spec))
    turn[0] = 0.0
    if len(close) % 2 == 0:
        turn[-1] = 0.0
    moved = np.fft.irfft(spec * np.exp(1j * turn), n=len(close))
    out = []
    for name, c in zip(SCENARIOS, (None, trend + moved + residual, trend + seasonal + residual * gain)):
        prices = {x: b[x] for x in PRICES}
        if c is not None:
            ratio = c / (close + EPS)
            prices = {x: c if x == "close" else b[x] * ratio for x in PRICES}
        out.append((name, {**prices, "_raw": {**prices, "volume": b["volume"]}}))
    return out


def scenario_trades(bars: DataFrame, p: Params = Params(), statistics: bool = True, window: int = 252,
                    tail: int = 5, dealt: bool = False) -> DataFrame:
    """Scored trades of the last ``window``..``tail``+1 bars: entry next open, exit close 4 bars on.

    The market is the fixed bull context of the reference; weekly and monthly flags come from the
    last completed period. Bars with ATR over 15% of the close, or below a falling 200-day
    average, are not traded, and leave the series step before their statistics are made. A symbol's scenarios are made and
    gone through in its own Arrow group: ``bars`` are exchanged once, or not at all where they come ``dealt`` by sym.
    """
    def traded(b: Columns, made: Columns) -> np.ndarray:
        c, rest = b["close"], len(b["close"]) - np.arange(len(b["close"]))
        wild = div(made["ATR"], c) > 0.15
        return (rest <= window) & (rest > tail) & ~(wild | ((c < made["SMA_200"]) & (made["SMA_50"] < made["SMA_200"])))

    def ahead(b: Columns) -> Columns:
        return {"entry": lead(b["open"]), "exit": lead(b["close"], 4), **period_columns(b)}

    bars = bars.select("sym", "dt", *PRICES, "volume").where("sym IS NOT NULL AND dt IS NOT NULL")
    df = series_features(bars, statistics, asked=traded, more=(ahead, {"entry": "double", "exit": "double", **PERIODS}),
                         dealt=dealt, copies=("scenario", scenario_columns))
    fixed = {"regime": "bull", "w_mul": 1.0, "vix": 18.0, "vix_scalar": 1.0, "macro_gravity": False,
             "is_credit_risk_high": False, "beta_60d": 1.0, "spy_realized_vol": 15.0, "tlt_corr": 0.0,
             "dxy_corr": 0.0, "rs_20": 0.0, "pure_alpha": 0.0, "rsi_60m_bounce": False,
             **{k: 0.0 for k in ALT_DEFAULTS}}
    df = df.withColumns({k: F.lit(v) for k, v in fixed.items()})
    df = df.withColumn("vrp", vrp(F.col("vix"), F.col("spy_realized_vol")))
    out = score_panel(df, p, keep=("sym", "dt", "scenario", "entry", "exit"))
    return out.where(F.col("score") >= p.min_score).withColumn(
        "ret", F.try_divide(F.col("exit") - F.col("entry"), F.col("entry")))


def scenario_report(trades: DataFrame, drop: float = 0.15) -> DataFrame:
    """scenario, trades, wins, ret_sum, win_rate, avg_ret, and whether the win rate fell by more
    than ``drop`` against the original."""
    t = trades.groupBy("scenario").agg(
        F.count("ret").alias("trades"), F.sum((F.col("ret") > 0).cast("long")).alias("wins"),
        F.sum("ret").alias("ret_sum"))
    t = materialise(t)  # a row for each scenario, read twice
    t = t.withColumns({"win_rate": F.coalesce(F.try_divide("wins", "trades"), F.lit(0.0)),
                       "avg_ret": F.coalesce(F.try_divide("ret_sum", "trades"), F.lit(0.0))})
    base = t.where("scenario = 'Original'").select(F.col("win_rate").alias("_base"))  # one row
    return t.crossJoin(F.broadcast(base)).withColumn("verdict", F.when(
        F.col("_base") - F.col("win_rate") > drop, "collapses").otherwise("robust")).drop("_base")
