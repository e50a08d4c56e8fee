"""The 64-entry factor vector: 48 named factors and 16 embedding elements.

Input is the feature panel of ``plans.panel``: indicators, previous-bar columns, cross-series and
period features, alternative data and market context, one row per (sym, dt). All expressions are
narrow projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.scalar import EPS, crosses_above, safe_div, scrub, yes
from sigloom.params import ALL_FACTORS, BASE_FACTORS, EMBEDDING_FACTORS, Params

ALT_DEFAULTS = {
    "pcr": 1.0, "iv_skew": 0.0, "short_change": 0.0, "short_float": 0.0, "insider": 0.0,
    "analyst": 0.0, "news_sentiment": 0.0, "mention_accel": 0.0,
}


def macd_crossed() -> Column:
    return crosses_above(F.col("prev_macd"), F.col("prev_signal"), F.col("MACD"), F.col("Signal_Line"))


def factor_columns(p: Params = Params()) -> dict[str, Column]:
    """name -> expression for the 48 named factors, null-scrubbed to +/-20."""
    c, o, h, lo, v = (F.col(x) for x in ("close", "open", "high", "low", "volume"))
    pc, atr = F.col("pc"), F.col("ATR")

    def pct(num: Column, den: Column) -> Column:
        """distance in percent of ``den``"""
        return safe_div(num, den * 0.01)

    def flag(x: Column) -> Column:
        return F.when(yes(x), 1.0).otherwise(0.0)

    def known(x: str, value: Column) -> Column:
        return F.when(F.col(x).isNotNull(), value).otherwise(0.0)

    cross = safe_div(F.col("MACD") - F.col("Signal_Line"), F.abs(c) * 0.01)
    burst = safe_div(v, F.col("Vol_MA20"), 50.0)
    hurst = F.when(
        F.col("hurst_reliable") & (F.col("hurst_med") > p.hurst_reliable),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("hurst_med") - 0.5) * 2.0))).otherwise(0.0)
    cols = {
        "minervini": safe_div(F.col("SMA_50") - F.col("SMA_200"), F.col("SMA_200")),
        "rel_strength": F.col("rs_20"),
        "macd_cross": cross,
        "ttm_squeeze": safe_div(
            F.col("KC_Upper") - F.col("KC_Lower") - (F.col("BB_Upper") - F.col("BB_Lower")), atr + EPS),
        "ichimoku": pct(c - F.greatest("SenkouA", "SenkouB"), c),
        "pullback": pct(c - F.col("EMA_20"), F.col("EMA_20")),
        "cmf": F.col("CMF"),
        "gap": pct(o - pc, pc),
        "vwap_break": pct(c - F.col("VWAP_20"), F.col("VWAP_20")),
        "avwap_break": known("AVWAP", pct(c - F.col("AVWAP"), F.col("AVWAP"))),
        "fvg": F.when(F.col("fvg_lower") > 0, pct(c - F.col("fvg_lower"), c)).otherwise(0.0),
        "liquidity_sweep": known("Swing_Low_20", pct(F.col("Swing_Low_20") - lo, lo)),
        "smart_money": F.col("Smart_Money_Flow"),
        "volume_stall": burst,
        "wide_up_bar": pct(c - o, o),
        "pocket_pivot": safe_div(v, F.col("Max_Down_Vol_10"), 50.0),
        "vcp": safe_div(F.col("Range_20"), F.col("Range_60") + EPS),
        "kde": F.col("kde_breakout_score"),
        "choch": pct(c - F.col("swing_high_10"), F.col("swing_high_10")),
        "order_block": known("OB_High", safe_div(
            c - F.col("OB_Low"), F.col("OB_High") - F.col("OB_Low") + EPS)),
        "amd": safe_div(F.least(o, c) - lo, F.col("TR") + EPS),
        "weekly_resonance": flag(F.col("weekly_bullish")),
        "cvd": F.col("CVD_Trend") * F.when(F.col("CVD_Divergence") == 1, 0.3).otherwise(1.0),
        "pure_alpha": F.col("pure_alpha"),
        "nr7": safe_div(F.col("Range"), atr + EPS),
        "vpt": F.when(F.col("VPT_Accel") > 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("VPT_ZScore")))
                      ).otherwise(0.0),
        "cross_x_volume": cross * burst,
        "cmf_x_smart": F.col("CMF") * F.col("Smart_Money_Flow"),
        "surge_price_3d": F.col("Recent_Price_Surge_3d"),
        "surge_vol_3d": F.col("Recent_Vol_Surge_3d"),
        "hurst": hurst,
        "fft": F.col("fft_ensemble_score"),
        "weekly_x_daily_macd": flag(F.col("weekly_macd_res") & macd_crossed()),
        "monthly_flow": flag(F.col("monthly_inst_flow")),
        "rsi_60m": flag(F.col("rsi_60m_bounce")),
        "beta": F.col("beta_60d"), "tlt_corr": F.col("tlt_corr"), "dxy_corr": F.col("dxy_corr"),
        "amihud": F.col("Amihud"), "dist_52w": F.col("Dist_52W_High"), "vrp": F.col("vrp"),
        "pcr": F.col("pcr"), "iv_skew": F.col("iv_skew"),
        "short_change": F.when(F.col("short_float") > p.short_float, F.col("short_change")).otherwise(0.0),
        "insider": F.col("insider"), "analyst": F.col("analyst"),
        "news_sentiment": F.col("news_sentiment"), "mention_accel": F.col("mention_accel"),
    }
    return {k: scrub(cols[k].cast("double"), 20.0) for k in BASE_FACTORS}


def embedding_columns(vector: str | None) -> dict[str, Column]:
    """alpha_t01.. from a 16-vector column; zeros when absent or of another length."""
    out = {}
    for k, name in enumerate(EMBEDDING_FACTORS):
        if vector is None:
            out[name] = F.lit(0.0)
        else:
            out[name] = F.when(F.size(vector) == 16, scrub(
                F.get(F.col(vector), F.lit(k)).cast("double"), 20.0)).otherwise(0.0)
    return out


def factor_map(panel: DataFrame, p: Params = Params(), vector: str | None = None) -> DataFrame:
    """sym, dt, ml_features MAP<STRING,DOUBLE> over all 64 names."""
    cols = {**factor_columns(p), **embedding_columns(vector)}
    pairs = [x for k in ALL_FACTORS for x in (F.lit(k), cols[k])]
    return panel.withColumn("ml_features", F.create_map(*pairs))


def factors_long(panel: DataFrame, names: tuple[str, ...] = ALL_FACTORS, p: Params = Params(),
                 carry: tuple[str, ...] = (), vector: str | None = None) -> DataFrame:
    """sym, dt, factor, value. ``names`` limits the row multiplication; ``vector`` names the column of the embedding."""
    cols = {**factor_columns(p), **embedding_columns(vector)}
    wide = panel.select("sym", "dt", *carry, *[cols[n].alias(n) for n in names])
    return wide.unpivot(["sym", "dt", *carry], list(names), "factor", "value")


def map_to_columns(rows: DataFrame, column: str = "ml_features", names: tuple[str, ...] = ALL_FACTORS) -> DataFrame:
    """A stored factor map as one column a name; an absent or unknown value is 0."""
    rest = [c for c in rows.columns if c != column and c not in names]
    return rows.select(*rest, *[F.coalesce(F.try_element_at(column, F.lit(n)), F.lit(0.0)).alias(n) for n in names])


def list_to_map(values: Column) -> Column:
    """A positional factor list (padded with 0) as the usual map."""
    padded = F.transform(
        F.sequence(F.lit(0), F.lit(len(ALL_FACTORS) - 1)),
        lambda i: F.coalesce(F.get(values, i), F.lit(0.0)))
    return F.map_from_arrays(F.array(*[F.lit(f) for f in ALL_FACTORS]), padded)
