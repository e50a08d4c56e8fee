"""The 48 indicator columns of one symbol's bars: one exchange on ``sym``, one Arrow group a symbol."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.scalar import EPS
from sigloom.functions.series import Columns, div, ewm, known, lag, per_symbol, prior, roll
from sigloom.functions.windows import BLOCK, span

INDICATORS = (
    "SMA_50", "SMA_150", "SMA_200", "EMA_20", "EMA_50", "RSI", "MACD", "Signal_Line", "TR", "ATR",
    "KC_Upper", "KC_Lower", "BB_Upper", "BB_Lower", "Tenkan", "Kijun", "SenkouA", "SenkouB",
    "Above_Cloud", "SuperTrend_Up", "CMF", "Range", "NR7", "Inside_Bar", "VPT_Cum", "VPT_ZScore",
    "VPT_Accel", "VWAP_20", "AVWAP", "Max_Down_Vol_10", "OB_High", "OB_Low", "Swing_Low_20",
    "Range_60", "Range_20", "Price_High_20", "Vol_MA20", "CVD_Smooth", "CVD_Trend",
    "CVD_Divergence", "Highest_22", "ATR_22", "Chandelier_Exit", "Smart_Money_Flow",
    "Recent_Price_Surge_3d", "Recent_Vol_Surge_3d", "Amihud", "Dist_52W_High",
)


WHOLE = {"Above_Cloud": "int", "SuperTrend_Up": "int", "CVD_Divergence": "int", "NR7": "boolean", "Inside_Bar": "boolean"}
KINDS = {x: WHOLE.get(x, "double") for x in INDICATORS}
TAIL = {"_i": "bigint", "_b": "bigint", "pc": "double", "ph": "double", "pl": "double", "po": "double"}


def rsi(gain: Column, loss: Column) -> Column:
    return F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + gain / (loss + F.lit(EPS)))


def level_columns(b: Columns) -> Columns:
    """Of the 48 columns those that the price levels of a position need."""
    c, h, lo, i = (b[x] for x in ("close", "high", "low", "_i"))
    pc = lag(c)
    tr = np.where(i >= 0, np.fmax(h - lo, np.fmax(np.abs(h - pc), np.abs(lo - pc))), np.nan)
    h22, atr22 = roll("max", h, 22), roll("mean", tr, 22)
    return {"TR": tr, "ATR": roll("mean", tr, 14), "SMA_200": roll("mean", c, 200, 40), "Highest_22": h22, "ATR_22": atr22,
            "Chandelier_Exit": h22 - 2.5 * atr22}


def indicator_columns(b: Columns, centered_accel: bool = False) -> Columns:
    """The 48 columns and ``_b``, ``pc``, ``ph``, ``pl``, ``po`` from filled prices, volume and ``_i``; nan until enough rows exist."""
    c, h, lo, o, v, i = (b[x] for x in ("close", "high", "low", "open", "volume", "_i"))
    row = np.arange(len(c))
    first = int((i < 0).sum())
    pc, ph, pl = lag(c), lag(h), lag(lo)
    clv = (c - lo - (h - c)) / np.fmax(h - lo, EPS)
    flow = c * v
    vol_ma = roll("mean", v, 20)
    h20, l20 = roll("max", h, 20), roll("min", lo, 20)
    ret, delta = div(c - pc, pc), c - pc
    levels = level_columns(b)
    step = known(ret) * v
    vpt = np.where(np.cumsum(~np.isnan(step)) > 0, np.cumsum(known(step)), np.nan)
    ema20, ema50 = ewm(c, span(20), first), ewm(c, span(50), first)
    macd = ewm(c, span(12), first) - ewm(c, span(26), first)
    gain = ewm(np.where(delta > 0, delta, 0.0), 1.0 / 14.0, first)
    loss = ewm(np.where(delta < 0, -delta, 0.0), 1.0 / 14.0, first)
    cvd = ewm(np.cumsum(known(div(v * (c - o), h - lo + EPS))), span(5), first, adjust=True)
    tenkan = (roll("max", h, 9) + roll("min", lo, 9)) / 2
    kijun = (roll("max", h, 26) + roll("min", lo, 26)) / 2
    ahead = lag((tenkan + kijun) / 2, 26), lag((roll("max", h, 52) + roll("min", lo, 52)) / 2, 26)
    # the newest surge bar at most 20 bars back
    surge = (c > pc * 1.04) & (v > vol_ma)
    at = np.maximum.accumulate(np.where(surge, row, -1))
    live = (at >= 0) & (i - i[at] <= 20)
    sd = roll("std", vpt, 50)
    z = (vpt - roll("mean", vpt, 50)) / np.where(np.isnan(sd) | (sd == 0), 1e-6, sd)
    z0 = known(z)
    if centered_accel:
        zp, zn = lag(z0), lag(z0[::-1])[::-1]
        accel = (np.where(np.isnan(zn), z0, zn) - np.where(np.isnan(zp), z0, zp)) / np.where(np.isnan(zn) | np.isnan(zp), 1.0, 2.0)
    else:
        accel = known(z0 - lag(z0))
    vwap = div(roll("sum", (h + lo + c) / 3 * v, 20), roll("sum", v, 20) + EPS)
    tr20 = roll("mean", levels["TR"], 20)
    bb, bb_sd = roll("mean", c, 20), roll("std", c, 20)
    h252 = roll("max", h, 252, 20)
    cmf = np.clip(div(roll("sum", clv * flow, 20), roll("sum", flow, 20) + EPS), -1, 1)
    return {
        **levels, "SMA_50": roll("mean", c, 50, 10), "SMA_150": roll("mean", c, 150, 30),
        "EMA_20": ema20, "EMA_50": ema50, "RSI": np.where(i >= 0, 100.0 - 100.0 / (1.0 + gain / (loss + EPS)), np.nan),
        "MACD": macd, "Signal_Line": ewm(macd, span(9), first),
        "KC_Upper": ema20 + 1.5 * tr20, "KC_Lower": ema20 - 1.5 * tr20, "BB_Upper": bb + 2 * bb_sd, "BB_Lower": bb - 2 * bb_sd,
        "Tenkan": tenkan, "Kijun": kijun, "SenkouA": ahead[0], "SenkouB": ahead[1],
        "Above_Cloud": c > np.fmax(*ahead), "SuperTrend_Up": c > ema20, "CMF": known(cmf),
        "Range": h - lo, "NR7": h - lo <= roll("min", h - lo, 7), "Inside_Bar": (h <= ph) & (lo >= pl),
        "VPT_Cum": vpt, "VPT_ZScore": z, "VPT_Accel": accel, "VWAP_20": vwap, "AVWAP": vwap,
        "Max_Down_Vol_10": prior("max", np.where(c < pc, v, 0.0), 10),
        "OB_High": np.where(live, ph[at], np.nan), "OB_Low": np.where(live, pl[at], np.nan), "Swing_Low_20": prior("min", lo, 20),
        "Range_60": roll("max", h, 60) - roll("min", lo, 60), "Range_20": h20 - l20, "Price_High_20": h20, "Vol_MA20": vol_ma,
        "CVD_Smooth": cvd, "CVD_Trend": np.where(roll("mean", cvd, 10) > roll("mean", cvd, 30), 1.0, -1.0),
        "CVD_Divergence": (c >= h20 * 0.99) & (cvd < roll("max", cvd, 20) * 0.95),
        "Smart_Money_Flow": roll("mean", clv, 10),
        "Recent_Price_Surge_3d": prior("max", div(c, o) - 1, 3) * 100, "Recent_Vol_Surge_3d": prior("max", v / (vol_ma + 1), 3),
        "Amihud": roll("mean", div(np.abs(ret), flow + EPS), 20) * 1e6, "Dist_52W_High": div(c - h252, h252 + EPS),
        "_i": i, "_b": np.trunc(i / BLOCK), "pc": pc, "ph": ph, "pl": pl, "po": lag(o),
    }


def levels(bars: DataFrame) -> DataFrame:
    """sym, dt, close, volume with ATR, Chandelier_Exit and SMA_200, for steps that read no other indicator."""
    return per_symbol(bars, level_columns, ["sym", "dt", "close", "volume"], {x: KINDS[x] for x in ("ATR", "Chandelier_Exit", "SMA_200")})


def indicators(bars: DataFrame, centered_accel: bool = False, keep: bool = False) -> DataFrame:
    """bars + 48 columns (with ``keep`` also those of the day before). Null until enough rows exist.

    Choices that differ from a literal reading of the reference, each on purpose:
    * CMF is the true 20-bar money flow (there an index mix-up made it 0).
    * VPT_Accel is the backward difference; ``centered_accel`` gives the centred one, which
      reads the next bar.
    * AVWAP is VWAP_20 and SuperTrend_Up is close > EMA_20, as there.
    """
    return per_symbol(bars, lambda b: indicator_columns(b, centered_accel), bars.columns, {**KINDS, **(TAIL if keep else {})})
