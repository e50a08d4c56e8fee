"""Thresholds and names shared by the operators, passed explicitly as one frozen record."""

from __future__ import annotations

from dataclasses import dataclass, field

# Factor names in vector order.
CORE_FACTORS = (
    "minervini", "rel_strength", "macd_cross", "ttm_squeeze", "ichimoku", "pullback", "cmf", "gap",
    "vwap_break", "avwap_break", "fvg", "liquidity_sweep", "smart_money", "volume_stall",
    "wide_up_bar", "pocket_pivot", "vcp", "choch", "order_block", "amd", "weekly_resonance",
)
MATH_FACTORS = (
    "kde", "hurst", "fft", "cvd", "pure_alpha", "nr7", "vpt", "beta", "tlt_corr", "dxy_corr",
    "amihud", "vrp",
)
INTERACTION_FACTORS = (
    "cross_x_volume", "cmf_x_smart", "surge_price_3d", "surge_vol_3d", "weekly_x_daily_macd",
    "rsi_60m", "dist_52w",
)
ALT_FACTORS = (
    "monthly_flow", "pcr", "iv_skew", "short_change", "insider", "analyst", "news_sentiment",
    "mention_accel",
)
EMBEDDING_FACTORS = tuple(f"alpha_t{i:02d}" for i in range(1, 17))
BASE_FACTORS = CORE_FACTORS + MATH_FACTORS + INTERACTION_FACTORS + ALT_FACTORS
ALL_FACTORS = BASE_FACTORS + EMBEDDING_FACTORS

# The two learner groups; nine names belong to both, three to neither.
GROUP_A = CORE_FACTORS + (
    "monthly_flow", "beta", "tlt_corr", "dxy_corr", "dist_52w", "insider", "analyst",
    "weekly_x_daily_macd", "surge_price_3d", "surge_vol_3d",
)
GROUP_B = MATH_FACTORS + ALT_FACTORS + ("fvg", "liquidity_sweep", "smart_money") + EMBEDDING_FACTORS

# Factors of the attribution report and the tag they are compared with.
ATTRIBUTION_FACTORS = ("fft", "hurst", "vpt", "cvd", "kde", "amihud", "vrp")
BASELINE_FACTOR = "macd_cross"

# Trigger themes; SHORT does not enter the score.
POSITIVE_THEMES = ("TREND", "VOLATILITY", "REVERSAL", "QUANTUM")
THEMES = POSITIVE_THEMES + ("SHORT",)


@dataclass(frozen=True)
class Params:
    """Every threshold the operators use."""

    min_score: float = 8.0
    crowding_penalty: float = 0.75
    crowding_min: int = 2
    crowding_exempt: tuple[str, ...] = ("QQQ",)
    default_sector: str = "SP500_WILD"
    portfolio_value: float = 100_000.0
    slippage: float = 0.003
    commission: float = 0.0005
    gap_limit: float = 0.03
    min_t_stat: float = 1.0
    pcr_bear: float = 1.5
    pcr_bull: float = 0.5
    skew_bear: float = 0.08
    skew_bull: float = -0.05
    short_change: float = 0.10
    short_float: float = 0.05
    vrp_extreme: float = 0.25
    mention_accel: float = 20.0
    analyst_up: float = 1.5
    analyst_down: float = -1.5
    news_bull: float = 0.3
    news_bear: float = -0.5
    insider_buy: float = 0.5
    amihud_illiquid: float = 0.5
    dist_52w: float = -0.05
    kde_breakout: float = 0.5
    hurst_reliable: float = 0.65
    fft_resonance: float = 0.71
    vcp_bull: float = 0.5
    vcp_bear: float = 0.4
    macd_waterline: float = 0.0
    # The reference computes this rule but its guard can never hold; off keeps its results.
    dedupe_cross: bool = False
    top_n: int = 5
    shadow_n: int = 150
    weights: dict = field(default_factory=dict)
