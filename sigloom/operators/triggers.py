"""52 conditional triggers over 45 tags, as data: (tag, condition, points, theme, sub-theme).

One nullable struct per rule, filtered to the ones that hold; no per-row Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.scalar import EPS, yes
from sigloom.operators.factors import macd_crossed
from sigloom.params import Params

MB, BR, PB = "MOMENTUM_BURST", "BOTTOM_REVERSAL", "PRICE_ACTION_BURST"


@dataclass(frozen=True)
class Rule:
    tag: str
    when: Column
    points: Column
    theme: str
    sub: str | None = None
    text: str = ""


def rules(p: Params = Params()) -> list[Rule]:
    """The rule table, in firing order. All thresholds and points in it."""
    c, o, h, lo, v = (F.col(x) for x in ("close", "open", "high", "low", "volume"))
    pc, atr, swing = F.col("pc"), F.col("ATR"), F.col("swing_high_10")
    sma50, sma150, sma200 = F.col("SMA_50"), F.col("SMA_150"), F.col("SMA_200")
    crossed = macd_crossed()
    bearish = F.col("regime").isin("bear", "hidden_bear")
    vixs, gravity = F.col("vix_scalar"), F.col("macro_gravity")
    kc = F.col("KC_Upper") - F.col("KC_Lower")
    bb = F.col("BB_Upper") - F.col("BB_Lower")
    atr_share = atr / (pc + EPS)
    gap = (o - pc) / (pc + EPS)
    day = (c - o) / (o + EPS) * 100
    span = h - lo + EPS
    up = c > o
    sl20 = F.col("Swing_Low_20")
    stalled = yes((v > F.col("Vol_MA20") * 2.0) & (F.abs(c - o) < atr * 0.5))
    cmf, smart = F.col("CMF"), F.coalesce(F.col("Smart_Money_Flow"), F.lit(0.0))

    def unit(x: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))

    absorb = 12 * (unit((cmf - 0.05) / 0.2) * 0.6 + unit((smart - 0.1) / 0.4) * 0.4)
    cvd_turn = yes((F.col("CVD_Trend") == 1.0) & (F.col("prev_cvd_trend") <= 0.0))
    beta, tlt, dxy = F.col("beta_60d"), F.col("tlt_corr"), F.col("dxy_corr")
    weekly, wmacd = F.col("weekly_bullish"), F.col("weekly_macd_res")
    dist = F.coalesce(F.col("Dist_52W_High"), F.lit(0.0))
    amihud = F.coalesce(F.col("Amihud"), F.lit(0.0))
    news, pcr, skew = F.col("news_sentiment"), F.col("pcr"), F.col("iv_skew")
    th = F.when(bearish, p.vcp_bear).otherwise(p.vcp_bull) * vixs
    hurst_on = F.col("hurst_reliable") & (F.col("hurst_med") > p.hurst_reliable)

    def n(x: float) -> Column:
        return F.lit(float(x))

    def whole(x: Column) -> Column:
        return x.cast("int").cast("double")

    return [
        Rule("minervini", (c > sma50) & (sma50 > sma150) & (sma150 > sma200),
             8 + whole((sma50 - sma200) / (sma200 + EPS) * 20), "TREND", None, "[Trend] averages stacked"),
        Rule("rel_strength", (F.col("rs_20") > 0) & (F.col("rs_20") > 1.0 + atr / (c + EPS) * 2.0),
             F.when(F.col("is_vol"), 7.0).otherwise(4.0), "TREND", MB, "[RelStrength] beats volatility threshold"),
        Rule("macd_cross", crossed, F.when(F.col("MACD") > p.macd_waterline, 12.0).otherwise(8.0),
             "TREND", MB, "[Momentum] MACD cross"),
        Rule("ichimoku", (F.col("Above_Cloud") == 1) & (F.col("Tenkan") > F.col("Kijun")), n(6), "TREND",
             None, "[Trend] above the cloud"),
        Rule("vwap_break", (c > F.col("VWAP_20")) & (pc <= F.col("VWAP_20")), n(8), "TREND", MB,
             "[Volume] through VWAP"),
        Rule("avwap_break", (c > F.col("AVWAP")) & (pc <= F.col("AVWAP")), n(12), "TREND", MB,
             "[Reclaim] through anchored VWAP"),
        Rule("ttm_squeeze", bb < kc, 8 + whole((kc - bb) / (atr + EPS) * 10), "VOLATILITY", None,
             "[Squeeze] bands inside channel"),
        Rule("nr7", F.col("prev_nr7") & F.col("prev_inside") & (c > F.col("ph")), n(12), "VOLATILITY", None,
             "[Compression] narrow inside bar broken up"),
        Rule("vcp", (F.col("Range_20") > 0) & (F.col("Range_20") < F.col("Range_60") * th) & (c > sma50),
             n(15), "VOLATILITY", None, "[VCP] range contraction"),
        Rule("liquidity_sweep", (lo < sl20) & (c > sl20), n(15), "REVERSAL", BR, "[Sweep] stop run reversed"),
        Rule("choch", (lo > sl20) & (c > swing), n(15), "REVERSAL", BR, "[Structure] swing high broken"),
        Rule("order_block", (lo <= F.col("OB_High")) & (c >= F.col("OB_Low")) & up, n(15), "REVERSAL", BR,
             "[OrderBlock] retest held"),
        Rule("kde", F.col("kde_breakout_score") > p.kde_breakout, 15 * F.col("kde_breakout_score"),
             "QUANTUM", None, "[Density] thin resistance"),
        Rule("hurst", hurst_on, 15 * (F.col("hurst_med") - 0.5) * 2.0, "QUANTUM", None,
             "[Memory] persistent series"),
        Rule("insider", F.col("insider") > p.insider_buy, n(20), "QUANTUM", None, "[Insider] cluster buying"),
        Rule("analyst", F.col("analyst") > p.analyst_up, n(8), "QUANTUM", None, "[Analyst] upgrades"),
        Rule("analyst", F.col("analyst") < p.analyst_down, n(-10), "TREND", None, "[Analyst] downgrades"),
        Rule("pure_alpha", F.col("pure_alpha") > 0.8, n(22), "TREND", None, "[Alpha] beats its beta"),
        Rule("pullback", (F.col("SuperTrend_Up") == 1) & (c < F.col("EMA_20") + atr * 0.5), n(10),
             "REVERSAL", BR, "[Pullback] near EMA20 in an up-trend"),
        Rule("gap", (gap > atr_share * 0.5) & (gap < atr_share * 2.0 * vixs), n(8), "VOLATILITY", None,
             "[Gap] breakaway"),
        Rule("fvg", (F.col("fvg_lower") > 0) & (lo <= F.col("fvg_upper")) & (c > F.col("fvg_lower")), n(15),
             "REVERSAL", BR, "[FVG] imbalance retest"),
        Rule("volume_stall", stalled & (c < sl20 * 1.05), n(12), "QUANTUM", None, "[Stall] absorption at the low"),
        Rule("wide_up_bar", (day > F.greatest(n(3), atr_share * 100 * 0.6)) & (v > F.col("Vol_MA20") * 1.5),
             n(12), "QUANTUM", PB, "[Impulse] wide up bar"),
        Rule("pocket_pivot", (c > pc) & (v > F.col("Max_Down_Vol_10")) & (F.col("Max_Down_Vol_10") > 0)
             & (c >= F.col("EMA_50")) & (pc <= F.col("EMA_50") * 1.02), n(12), "REVERSAL", BR,
             "[Pivot] pocket pivot"),
        Rule("amd", up & ((o - lo) / span > 0.3) & ((h - c) / span < 0.15), n(12), "REVERSAL", None,
             "[AMD] opening drive reversed"),
        Rule("weekly_resonance", weekly & (c > F.col("Highest_22") * 0.95), n(20), "QUANTUM", None,
             "[Resonance] weekly and daily agree"),
        Rule("cvd", cvd_turn & (F.col("CVD_Divergence") == 0), n(12), "QUANTUM", PB, "[CVD] buyers take over"),
        Rule("vpt", (F.col("VPT_ZScore") > 0.5) & (F.col("VPT_Accel") > 0) & (F.col("prev_vpt_z") <= 0.5),
             n(10), "TREND", MB, "[VPT] price-volume breakout"),
        Rule("cross_x_volume", crossed, n(12), "TREND", MB, "[Interaction] cross with volume"),
        Rule("cmf_x_smart", (cmf > 0.05) & (smart > 0.1) & (absorb > 3.0), absorb, "QUANTUM", PB,
             "[Interaction] flows agree"),
        Rule("fft", F.col("fft_ensemble_score") >= p.fft_resonance, n(15), "QUANTUM", None,
             "[Cycle] windows agree on the upswing"),
        Rule("weekly_x_daily_macd", wmacd & crossed, n(15), "TREND", None, "[MultiTime] weekly MACD backs the cross"),
        Rule("monthly_flow", F.col("monthly_inst_flow"), n(10), "QUANTUM", None, "[Monthly] three months of inflow"),
        Rule("rsi_60m", F.col("rsi_60m_bounce"), n(8), "REVERSAL", BR, "[Hourly] RSI bounce"),
        Rule("beta", (beta > 1.2) & ~gravity, n(7), "TREND", None, "[Beta] elastic in a calm market"),
        Rule("beta", (beta > 1.2) & gravity, n(-10), "TREND", None, "[Beta] exposed under stress"),
        Rule("tlt_corr", tlt > 0.4, n(8), "TREND", None, "[Rates] moves with bonds"),
        Rule("tlt_corr", tlt < -0.4, n(6), "TREND", None, "[Rates] moves against bonds"),
        Rule("dxy_corr", dxy < -0.4, n(8), "QUANTUM", None, "[Dollar] gains from a weak dollar"),
        Rule("dxy_corr", dxy > 0.4, n(6), "QUANTUM", None, "[Dollar] moves with the dollar"),
        Rule("dist_52w", (dist > p.dist_52w) & weekly, n(10), "TREND", None, "[High] near the 52-week high"),
        Rule("amihud", (amihud > p.amihud_illiquid) & gravity, n(-10), "VOLATILITY", None,
             "[Liquidity] thin under stress"),
        Rule("vrp", F.col("vrp") > p.vrp_extreme, n(12), "QUANTUM", None, "[VRP] rich volatility premium"),
        Rule("news_sentiment", news > p.news_bull, 10 * F.least(n(1), news / 0.8), "VOLATILITY", None,
             "[News] strongly positive"),
        Rule("news_sentiment", news < p.news_bear, n(-10), "VOLATILITY", None, "[News] strongly negative"),
        Rule("mention_accel", F.col("mention_accel") > p.mention_accel, n(8), "VOLATILITY", None,
             "[Mentions] accelerating"),
        Rule("pcr", pcr > p.pcr_bear, n(15), "SHORT", None, "[Options] heavy put buying"),
        Rule("pcr", (pcr > 0) & (pcr < p.pcr_bull), n(10), "QUANTUM", None, "[Options] heavy call buying"),
        Rule("iv_skew", skew > p.skew_bear, n(20), "SHORT", None, "[Skew] puts bid"),
        Rule("iv_skew", skew < p.skew_bull, n(12), "QUANTUM", None, "[Skew] calls bid"),
        Rule("short_change", (F.col("short_change") > p.short_change) & (F.col("short_float") > p.short_float)
             & (c > F.col("EMA_20")), n(15), "QUANTUM", None, "[Squeeze] shorts rising in an up-trend"),
        Rule("credit_risk", F.col("is_credit_risk_high"), n(15), "SHORT", None, "[Credit] spread widening"),
    ]


def warnings() -> list[tuple[Column, str]]:
    """Texts without points: distribution near the high, divergent volume delta."""
    c, o, v = F.col("close"), F.col("open"), F.col("volume")
    stalled = yes((v > F.col("Vol_MA20") * 2.0) & (F.abs(c - o) < F.col("ATR") * 0.5))
    low_stall = yes(c < F.col("Swing_Low_20") * 1.05)
    turn = yes((F.col("CVD_Trend") == 1.0) & (F.col("prev_cvd_trend") <= 0.0))
    return [
        (stalled & ~low_stall & yes(c > F.col("swing_high_10") * 0.95), "[Warning] heavy volume stalls near the high"),
        (turn & (F.col("CVD_Divergence") != 0), "[Warning] volume delta diverges from price"),
    ]


def regime_multiplier(theme: str) -> Column:
    r = F.col("regime")
    bear, bull = r.isin("bear", "hidden_bear"), r.isin("bull", "rebound")
    x = F.lit(1.0)
    if theme in ("TREND", "VOLATILITY"):
        x = F.when(bear, 0.6).when(bull, 1.2).otherwise(1.0)
    elif theme == "QUANTUM":
        x = F.when(bull, 1.2).otherwise(1.0)
    elif theme == "REVERSAL":
        x = F.when(bear, 1.4).otherwise(1.0)
    return x


def weighted_rules(p: Params = Params()) -> list[tuple[str, Rule]]:
    """(column name, rule) of the rules whose factor weight is positive; the others are off."""
    live = [r for r in rules(p) if float(p.weights.get(r.tag, 1.0)) > 0]
    return [(f"t{k:02d}", r) for k, r in enumerate(live)]


def with_points(panel: DataFrame, p: Params = Params(), keep: tuple[str, ...] | None = None) -> DataFrame:
    """Add one nullable points column per rule: null when the rule does not hold.

    Points carry the factor weight and the regime multiplier. Plain columns instead of an array
    keep the whole score inside generated code.
    """
    cols = {}
    for name, r in weighted_rules(p):
        w = float(p.weights.get(r.tag, 1.0))
        pts = r.points * F.col("w_mul") * w * regime_multiplier(r.theme)
        cols[name] = F.when(yes(r.when), pts.cast("double"))
    kept = list(keep) if keep is not None else panel.columns
    return panel.select(*kept, *[c.alias(k) for k, c in cols.items()],
                        F.array_compact(F.array(*[F.when(w, F.lit(t)) for w, t in warnings()])).alias("notes"))


def fired(p: Params, of: str) -> Column:
    """The tags (or texts) of the rules that hold, in firing order."""
    return F.array_compact(F.array(*[
        F.when(F.col(n).isNotNull(), F.lit(getattr(r, of))) for n, r in weighted_rules(p)]))


def triggers_long(panel: DataFrame, p: Params = Params()) -> DataFrame:
    """sym, dt, tag, points, theme, sub: one row per trigger that fired."""
    pts = with_points(panel, p, ("sym", "dt"))
    items = [F.when(F.col(n).isNotNull(), F.struct(
        F.lit(r.tag).alias("tag"), F.col(n).alias("points"), F.lit(r.theme).alias("theme"),
        F.lit(r.sub).cast("string").alias("sub"))) for n, r in weighted_rules(p)]
    t = pts.select("sym", "dt", F.explode(F.array_compact(F.array(*items))).alias("t"))
    return t.select("sym", "dt", "t.tag", "t.points", "t.theme", "t.sub")
