"""Features that need a second series or a second time frame.

Look-ahead: history uses the last *completed* week and month; ``live=True`` takes the running ones
on each symbol's newest bar.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigloom.functions.asof import asof_join
from sigloom.functions.scalar import EPS, yes
from sigloom.functions.series import Columns, cov as ncov, div, ewm as newm, filled, known, lag as nlag, per_symbol, roll as nroll
from sigloom.functions.windows import as_series, by_time, index_series, lag, roll, span, with_ewm
from sigloom.operators.bars import monthly_bars, weekly_bars
from sigloom.operators.indicators import rsi


def weekly_state(weekly: DataFrame) -> DataFrame:
    """Per symbol and week: weekly_bullish, weekly_macd_res (both false under 40 weeks)."""
    df = index_series(weekly.select("sym", "dt", "close"))
    df = with_ewm(df, {f"e{n}": ("close", span(n), False) for n in (10, 12, 26, 30)})
    df = df.withColumns({"macd": F.col("e12") - F.col("e26"), "m40": roll(F.avg, "close", 40)})
    df = with_ewm(df, {"sig": ("macd", span(9), False)})
    df = df.withColumn("hist", F.col("macd") - F.col("sig"))
    long_enough = F.col("_i") >= 39
    return df.select(
        "sym", "dt",
        (long_enough & yes(F.col("close") > F.col("m40")) & yes(F.col("close") > F.col("e10"))
         & yes(F.col("e10") > F.col("e30"))).alias("weekly_bullish"),
        (long_enough & yes(F.col("hist") > 0) & yes(F.col("hist") > lag("hist"))).alias(
            "weekly_macd_res"),
    )


def monthly_state(monthly: DataFrame) -> DataFrame:
    """Per symbol and month: three months in a row with positive money flow."""
    flow = (F.col("close") - F.col("open")) / (F.col("high") - F.col("low") + EPS) * F.col("volume")
    w = by_time().rowsBetween(-2, 0)
    return monthly.select(
        "sym", "dt",
        yes((F.count(F.lit(1)).over(w) == 3) & (F.min(flow).over(w) > 0)).alias("monthly_inst_flow"))


def period_state(state: DataFrame, flags: list[str]) -> DataFrame:
    """Of each period its own flags (``_now``) and those of the period before it (``_done``)."""
    w = by_time()
    return state.select("sym", "dt", *[F.col(f).alias(f"{f}_now") for f in flags],
                        *[F.coalesce(F.lag(f).over(w), F.lit(False)).alias(f"{f}_done") for f in flags])


def rsi_60m_state(hourly: DataFrame) -> DataFrame:
    """Per hourly bar: RSI with span-14 averages, and the bounce (rising from under 40)."""
    df = as_series(hourly)
    delta = F.col("close") - lag("close")
    df = df.withColumns({"g": F.when(yes(delta > 0), delta).otherwise(0.0),
                         "d": F.when(yes(delta < 0), -delta).otherwise(0.0)})
    df = with_ewm(df, {"g14": ("g", span(14), False), "d14": ("d", span(14), False)})
    df = df.withColumn("rsi_60m", rsi(F.col("g14"), F.col("d14")))
    prev = lag("rsi_60m")
    return df.select("sym", "dt", "rsi_60m", yes(
        (F.col("_i") >= 14) & (F.col("rsi_60m") > prev) & (prev < 40)).alias("rsi_60m_bounce"))


def with_hourly(days: DataFrame, hourly: DataFrame, max_age_days: float = 3.0) -> DataFrame:
    """``days`` (sym, dt, ...) with the state of the newest hour bar up to the end of the day: rsi_60m, rsi_60m_bounce.

    Hours that are older than ``max_age_days`` at the end of the day do not count.
    """
    out = asof_join(days, rsi_60m_state(hourly), "sym", F.date_add("dt", 1).cast("timestamp"), F.col("dt").cast("timestamp"),
                    {c: F.col(c) for c in ("rsi_60m", "rsi_60m_bounce")}, max_age_days * 86400, strict=True)
    return out.withColumn("rsi_60m_bounce", F.coalesce("rsi_60m_bounce", F.lit(False)))


PERIODS = {"weekly_bullish": "boolean", "weekly_macd_res": "boolean", "monthly_inst_flow": "boolean"}
HOURS = {"rsi_60m": "double", "rsi_60m_bounce": "boolean"}


def period_columns(b: Columns, live: bool = False) -> Columns:
    """``with_periods`` of one symbol's bars, from ``_day`` and the prices and volume as they are."""
    raw, day = b["_raw"], b["_day"]

    def periods(label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last row of each period, and the period of each row."""
        new = np.concatenate([[True], label[1:] != label[:-1]])
        first = np.flatnonzero(new)
        return first, np.append(first[1:], len(label)) - 1, np.cumsum(new) - 1

    def spread(now: np.ndarray, of: np.ndarray) -> np.ndarray:
        out = np.concatenate([[False], now[:-1]])[of]
        if live:
            out[-1] = now[of[-1]]
        return out

    _, last, of = periods((day + 3) // 7)  # weeks begin on Monday
    c = raw["close"][last]
    e10, e12, e26, e30 = (newm(c, span(n), 0) for n in (10, 12, 26, 30))
    hist = e12 - e26
    hist = hist - newm(hist, span(9), 0)
    grown = np.arange(len(c)) >= 39
    out = {"weekly_bullish": spread(grown & (c > nroll("mean", c, 40)) & (c > e10) & (e10 > e30), of),
           "weekly_macd_res": spread(grown & (hist > 0) & (hist > nlag(hist)), of)}
    first, last, of = periods(day.astype("datetime64[D]").astype("datetime64[M]").astype(int))
    reach = np.fmax.reduceat(raw["high"], first) - np.fmin.reduceat(raw["low"], first) + EPS
    none = np.isnan(raw["volume"])
    volume = np.add.reduceat(known(raw["volume"]), first)
    volume[np.logical_and.reduceat(none, first)] = np.nan
    flow = (raw["close"][last] - raw["open"][first]) / reach * volume
    three = np.arange(len(flow)) >= 2
    return {**out, "monthly_inst_flow": spread(three & (nroll("min", flow, 3, 1) > 0), of)}


def hour_columns(end: np.ndarray, hours: np.ndarray | None, max_age_days: float = 3.0) -> Columns:
    """``with_hourly`` of one symbol's bars: ``end`` is the second at which each day ends, ``hours`` has second, rsi_60m and bounce."""
    if hours is None:
        return {"rsi_60m": np.full(len(end), np.nan), "rsi_60m_bounce": np.zeros(len(end), bool)}
    hours = hours[np.argsort(hours[:, 0], kind="stable")]
    place = np.searchsorted(hours[:, 0], end, side="left") - 1
    at = np.maximum(place, 0)
    fits = (place >= 0) & (end - hours[at, 0] <= max_age_days * 86400)
    return {"rsi_60m": np.where(fits, hours[at, 1], np.nan), "rsi_60m_bounce": fits & (hours[at, 2] == 1)}


def earnings_columns(day: np.ndarray, announced: np.ndarray | None, days: int = 5) -> np.ndarray:
    """``earnings_flag`` of one symbol's bars: whether an announcement falls within 0..days of each day."""
    if announced is None:
        return np.zeros(len(day), bool)
    dates = np.append(np.sort(announced[:, 0]), np.inf)
    return dates[np.searchsorted(dates, day)] <= day + days


GAP = {"fvg_lower": "double", "fvg_upper": "double"}
SWING = {"swing_high_10": "double"}
CROSS = {x: "double" for x in ("beta_60d", "spy_realized_vol", "tlt_corr", "dxy_corr", "rs_20", "pure_alpha")}
WIDE = ("qqq_close", "spy_ret", "tlt_ret", "dxy_ret")


def gap_columns(b: Columns) -> Columns:
    h2, low, row = nlag(b["high"], 2), b["low"], np.arange(len(b["low"]))
    at = nlag(np.maximum.accumulate(np.where(low > h2, row, -1)))
    hit = (b["_i"] >= 21) & (at >= 0) & (at >= row - 19)
    at = np.where(hit, at, 0).astype(int)
    return {"fvg_lower": np.where(hit, h2[at], 0.0), "fvg_upper": np.where(hit, low[at], 0.0)}


def swing_columns(b: Columns) -> Columns:
    return {"swing_high_10": np.where(b["_i"] >= 10, nlag(nroll("max", b["high"], 10, 1)), b["high"])}


def cross_columns(b: Columns) -> Columns:
    i, c, qqq = b["_i"], b["close"], b["qqq_close"]
    r = known(div(c, nlag(c)) - 1)
    s, t, d = (known(b[x]) for x in WIDE[1:])
    kept: dict = {}

    def corr(y: np.ndarray, n: int) -> np.ndarray:
        spread = np.sqrt(ncov(r, r, n, kept) * ncov(y, y, n, kept))
        return np.where((i >= n - 1) & (spread > 0), div(ncov(r, y, n, kept), spread), 0.0)

    market = ncov(s, s, 60, kept)
    # rows that both calendars have form a series of their own
    both = np.flatnonzero(~np.isnan(qqq) & ~np.isnan(c))
    cb, qb = c[both], qqq[both]
    x, q = div(cb, nlag(cb)) - 1, div(qb, nlag(qb)) - 1
    ok = np.arange(len(both)) >= 59
    vq = ncov(q, q, 60, kept)
    slope = np.where(vq > 0, ncov(x, q, 60, kept) / (vq + EPS), 1.0)
    rs = div(div(cb, nlag(cb, 19)), np.fmax(div(qb, nlag(qb, 19)), 0.5))
    pa = (nroll("mean", x, 5, 1) - slope * nroll("mean", q, 5, 1)) * 252
    out = {}
    for name, y in (("rs_20", rs), ("pure_alpha", pa)):
        line = np.full(len(c), np.nan)
        line[both] = np.where(ok, y, np.nan)
        out[name] = known(filled(line))
    return {**out, "beta_60d": np.where((i >= 59) & (market > 0), div(ncov(r, s, 60, kept), market), 1.0),
            "spy_realized_vol": np.where(i >= 59, np.sqrt(ncov(s, s, 20)) * np.sqrt(252.0) * 100, 15.0),
            "tlt_corr": corr(t, 90), "dxy_corr": corr(d, 20)}


def price_gap(df: DataFrame) -> DataFrame:
    """fvg_lower / fvg_upper: the newest of the 19 bars before today that opened a gap over the
    bar two before it."""
    return per_symbol(df, gap_columns, df.columns, GAP)


def swing_high(df: DataFrame) -> DataFrame:
    """Highest high of the ten bars before today; today's high under 11 rows."""
    return per_symbol(df, swing_columns, df.columns, SWING)


def cross_series(df: DataFrame, wide: DataFrame) -> DataFrame:
    """beta_60d, spy_realized_vol, tlt_corr, dxy_corr, rs_20, pure_alpha per symbol-day.

    ``wide`` is ``macro_wide`` (one row per date). Stock returns on dates the macro series lacks
    meet a 0 return, except for rs_20 and pure_alpha, which live on the dates both sides have and
    carry their last value over the others.
    """
    return per_symbol(df.join(wide, "dt", "left"), cross_columns, df.columns, CROSS)


def vrp(vix: Column, realized: Column) -> Column:
    return (vix - realized) / F.greatest(vix, F.lit(1.0))


def with_periods(df: DataFrame, bars: DataFrame, live: bool = False) -> DataFrame:
    """Attach weekly and monthly flags by equality on (sym, period label).

    A bar of the past has those of the last completed week and month. With ``live``, the newest bar of each symbol has
    those of the running ones, as a scan of that day sees them.
    """
    flags = ("weekly_bullish", "weekly_macd_res", "monthly_inst_flow")
    wk = period_state(weekly_state(weekly_bars(bars)), list(flags[:2]))
    mo = period_state(monthly_state(monthly_bars(bars)), [flags[2]])
    newest = F.lead("dt").over(by_time()).isNull() if live else F.lit(False)
    df = df.withColumns({"_new": newest, "_wk": F.date_add(F.to_date(F.date_trunc("week", "dt")), 6), "_mo": F.last_day("dt")})
    df = df.join(wk.withColumnRenamed("dt", "_wk"), ["sym", "_wk"], "left")
    df = df.join(mo.withColumnRenamed("dt", "_mo"), ["sym", "_mo"], "left")
    state = {f: F.coalesce(F.when(F.col("_new"), F.col(f"{f}_now")).otherwise(F.col(f"{f}_done")), F.lit(False)) for f in flags}
    return df.withColumns(state).drop("_new", "_wk", "_mo", *[f"{f}_{k}" for f in flags for k in ("now", "done")])
