"""The SQL twin of each registered query (see ``oracle`` for the shared fragments)."""

from __future__ import annotations

from sigloom.plans.oracle import F, L, q, seq_sums

OHLCV = "sym:i dt:d open:f high:f low:f close:f volume:f"
SQL: dict[str, str] = {}

# --- bars -----------------------------------------------------------------------------------
SQL["bars_daily"] = q("bars", OHLCV)
SQL["bars_weekly"] = q("weeks", OHLCV)
SQL["bars_monthly"] = q("months", OHLCV)
SQL["bars_hourly"] = q("hours", OHLCV.replace("dt:d", "dt:t"))
SQL["dedupe_last"] = q("SELECT sym, dt, close, volume + 1 AS volume FROM bars", "sym:i dt:d close:f volume:f")
SQL["period_cut"] = q("bars", "sym:i dt:d close:f", "WHERE dt >= (SELECT max(dt) - 90 FROM bars)")
SQL["last_five_bars"] = q("""SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY sym ORDER BY dt DESC) <= 5""",
                          "sym:i dt:d close:f")
SQL["close_history"] = q("""SELECT sym, count(*) AS n, arg_min(close, dt) AS oldest, arg_max(close, dt) AS newest,
  sum(close) AS total FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY sym ORDER BY dt DESC) <= 60)
  GROUP BY sym""", "sym:i n:i oldest:f newest:f total:f")
SQL["universe"] = """SELECT sym FROM (SELECT replace(s_name, '.', '-') AS sym FROM supplier
  UNION SELECT replace(n_name, '.', '-') FROM nation) ORDER BY md5('u' || sym), sym LIMIT 50"""
SQL["calendar_index"] = q("SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS idx FROM (SELECT DISTINCT dt FROM bars)",
                          "dt:d idx:i")

# --- indicators -----------------------------------------------------------------------------
IND = {
    "ind_sma": "SMA_50:f SMA_150:f SMA_200:f", "ind_ema": "EMA_20:f EMA_50:f", "ind_rsi": "RSI:f",
    "ind_macd": "MACD:f Signal_Line:f", "ind_keltner": "KC_Upper:f KC_Lower:f",
    "ind_bollinger": "BB_Upper:f BB_Lower:f",
    "ind_ichimoku": "Tenkan:f Kijun:f SenkouA:f SenkouB:f Above_Cloud:b SuperTrend_Up:b",
    "ind_atr_chandelier": "TR:f ATR:f ATR_22:f Highest_22:f Chandelier_Exit:f",
    "ind_money_flow": "CMF:f Smart_Money_Flow:f", "ind_vpt": "VPT_Cum:f VPT_ZScore:f VPT_Accel:f",
    "ind_vwap": "VWAP_20:f VWAP_20=AVWAP:f", "ind_orderblock": "OB_High:f OB_Low:f Swing_Low_20:f",
    "ind_ranges": "Range:f NR7:b Inside_Bar:b Range_60:f Range_20:f Price_High_20:f",
    "ind_volume": "Vol_MA20:f Max_Down_Vol_10:f", "ind_cvd": "CVD_Smooth:f CVD_Trend:f CVD_Divergence:i",
    "ind_amihud": "Amihud:f", "ind_surge": "Recent_Price_Surge_3d:f Recent_Vol_Surge_3d:f",
    "ind_dist_52w": "Dist_52W_High:f",
}
for _n, _c in IND.items():
    SQL[_n] = q("ind", "sym:i dt:d " + _c)

# --- context and features -------------------------------------------------------------------
SQL["market_regime"] = q("regimes", "dt:d close:f sma50:f sma200:f trend20:f regime:s")
SQL["vix_band"] = q("vixes", "dt:d vix:f vix_band:s")
SQL["credit_spread"] = q("SELECT *, coalesce(mom < -0.02e0, false) AS risk FROM credit",
                         "dt:d ratio:f mom=credit_spread_mom:f risk=is_credit_risk_high:b")
SQL["market_context"] = q("ctx", "dt:d regime:s vix:f mom=credit_spread_mom:f risk=is_credit_risk_high:b exposure:f "
                                 "health:f min_score=dynamic_min_score:f")
SQL["feat_beta"] = q("cross_feats", "sym:i dt:d beta_60d:f")
SQL["feat_corr"] = q("cross_feats", "sym:i dt:d tlt_corr:f dxy_corr:f")
SQL["feat_rel_strength"] = q("cross_feats", "sym:i dt:d rs_20:f pure_alpha:f")
SQL["feat_vrp"] = q("cross_feats", "sym:i dt:d spy_vol=spy_realized_vol:f vrp:f")
SQL["feat_weekly"] = q("period_feats", "sym:i dt:d weekly_bullish:b weekly_macd_res:b")
SQL["feat_monthly_flow"] = q("period_feats", "sym:i dt:d monthly_inst_flow:b")
SQL["feat_rsi_60m"] = q(f"SELECT *, coalesce(i >= 14 AND rsi > {L('rsi')} AND {L('rsi')} < 40, false) AS bounce FROM hr1",
                        "sym:i dt:t rsi=rsi_60m:f bounce=rsi_60m_bounce:b")
SQL["feat_fvg"] = q("gap_feats", "sym:i dt:d fvg_lower:f fvg_upper:f")
SQL["feat_swing"] = q("gap_feats", "sym:i dt:d swing_high_10:f")
SQL["feat_kde"] = q("SELECT b.sym, b.dt, coalesce(k.score, 0) AS score FROM bars b LEFT JOIN kde_stat k ON b.sym = k.sym AND b.dt = k.dt",
                    "sym:i dt:d score=kde_breakout_score:f")
SQL["feat_fft"] = q("SELECT b.sym, b.dt, coalesce(k.score, 0) AS score FROM bars b LEFT JOIN fft_vote k ON b.sym = k.sym AND b.dt = k.dt",
                    "sym:i dt:d score=fft_ensemble_score:f")
SQL["feat_hurst"] = q("""SELECT b.sym, b.dt, coalesce(med, 0.5e0) AS med, coalesce(iqr, 0) AS iqr, coalesce(sure, false) AS sure
  FROM bars b LEFT JOIN hurst_stat h ON b.sym = h.sym AND b.dt = h.dt""", "sym:i dt:d med=hurst_med:f iqr=hurst_iqr:f sure=hurst_reliable:b")

# --- alternative data -----------------------------------------------------------------------
F["chain"] = """
SELECT l_suppkey AS sym, CAST(date_trunc('month', l_shipdate) AS DATE) AS expiry, l_linestatus = 'O' AS is_call,
  l_quantity AS volume, l_discount AS iv FROM lineitem
QUALIFY CAST(date_trunc('month', l_shipdate) AS DATE) = min(CAST(date_trunc('month', l_shipdate) AS DATE)) OVER (PARTITION BY l_suppkey)"""
F["a_pcr"] = """
SELECT sym, coalesce(coalesce(sum(volume) FILTER (NOT is_call), 0) / sum(volume) FILTER (is_call), 1) AS pcr FROM chain GROUP BY sym"""
SQL["alt_pcr"] = q("a_pcr", "sym:i pcr:f")
F["a_skew"] = """
SELECT sym, coalesce(median(iv) FILTER (NOT is_call) - median(iv) FILTER (is_call), 0) AS iv_skew FROM chain
  GROUP BY sym"""
SQL["alt_skew"] = q("a_skew", "sym:i iv_skew:f")
F["interest"] = """
SELECT l_suppkey AS sym, date_trunc('month', l_shipdate) AS month,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS short, sum(l_quantity) AS total
FROM lineitem GROUP BY 1, 2"""
F["a_short"] = """
SELECT sym, CASE WHEN short <> 0 AND prev > 0 THEN (short - prev) / prev ELSE 0 END AS short_change, short / total AS short_float
  FROM (SELECT *, lag(short) OVER w AS prev, row_number() OVER (PARTITION BY sym ORDER BY month DESC) AS rn FROM interest
    WINDOW w AS (PARTITION BY sym ORDER BY month)) WHERE rn = 1"""
SQL["alt_short"] = q("a_short", "sym:i short_change:f short_float:f")
F["tx"] = """
SELECT c_nationkey AS sym, o_orderkey AS id, CAST(o_orderdate AS DATE) AS dt, o_orderpriority AS prio,
  o_totalprice * CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END AS shares
FROM orders JOIN customer ON o_custkey = c_custkey"""
F["a_insider"] = """
SELECT sym, coalesce((b - s) / nullif(b + s, 0), 0) AS insider FROM (
  SELECT sym, sum(greatest(shares, 0)) AS b, sum(greatest(-shares, 0)) AS s FROM (
    SELECT * FROM tx QUALIFY row_number() OVER (PARTITION BY sym ORDER BY dt DESC, id DESC) <= 20) GROUP BY sym)"""
SQL["alt_insider"] = q("a_insider", "sym:i insider:f")
F["acts"] = """
SELECT *, CASE substr(prio, 1, 1) WHEN '1' THEN 1e0 WHEN '2' THEN 0.5e0 WHEN '5' THEN -1e0 ELSE 0e0 END AS sc,
  min(dt) OVER (PARTITION BY sym) AS d0 FROM tx WHERE dt >= (SELECT max(dt) - 365 FROM tx)"""
F["buckets"] = """
SELECT g.sym, g.b, g.b = g.last AS newest, coalesce(s.v, 0) AS v FROM (
  SELECT sym, unnest(range(0, last + 1)) AS b, last FROM (
    SELECT sym, max((dt - d0) // 30) AS last FROM acts GROUP BY sym)) g
LEFT JOIN (SELECT sym, (dt - d0) // 30 AS b, sum(sc) AS v FROM acts GROUP BY 1, 2) s ON g.sym = s.sym AND g.b = s.b"""
F["a_analyst"] = """
SELECT sym, CASE WHEN count(*) >= 3 THEN (max(v) FILTER (newest) - avg(v) FILTER (NOT newest))
  / (stddev_samp(v) FILTER (NOT newest) + 1e-5) ELSE sum(v) * 0.1e0 END AS analyst FROM buckets GROUP BY sym"""
SQL["alt_analyst"] = q("a_analyst", "sym:i analyst:f")
F["talk"] = """
SELECT CAST(ts AS DATE) AS day, user_id AS ticker, count(*) AS n, dense_rank() OVER (ORDER BY CAST(ts AS DATE) DESC) AS k
FROM events WHERE event_type = 'view' GROUP BY 1, 2"""
F["a_talk"] = """
SELECT ticker, CASE WHEN (SELECT max(k) FROM talk) >= 3 THEN
    coalesce(sum(n) FILTER (k = 1), 0) - 2 * coalesce(sum(n) FILTER (k = 2), 0) + coalesce(sum(n) FILTER (k = 3), 0) ELSE 0 END AS mention_accel
  FROM talk GROUP BY ticker HAVING min(k) = 1"""
SQL["alt_mentions"] = q("a_talk", "ticker:i mention_accel:f")
SQL["mention_history"] = q("talk", "day:d ticker:i n=comments:i", "WHERE k <= 5")
F["soon"] = """
SELECT sym, dt, EXISTS (SELECT 1 FROM lineitem e WHERE e.l_suppkey = b.sym AND e.l_linenumber = 1 AND e.l_returnflag = 'R'
  AND CAST(e.l_shipdate AS DATE) >= b.dt AND CAST(e.l_shipdate AS DATE) <= b.dt + 5) AS soon FROM bars b"""
SQL["alt_earnings"] = q("soon", "sym:i dt:d soon=earnings_soon:b")

# --- factors, triggers, score ---------------------------------------------------------------
F["alt"] = """
SELECT b.sym, b.dt, coalesce(p.pcr, 1) AS pcr, coalesce(k.iv_skew, 0) AS iv_skew, coalesce(h.short_change, 0) AS short_change,
  coalesce(h.short_float, 0) AS short_float, coalesce(n.insider, 0) AS insider, coalesce(a.analyst, 0) AS analyst,
  coalesce(t.mention_accel, 0) AS mention_accel
FROM (SELECT sym, max(dt) AS dt FROM bars GROUP BY sym) b LEFT JOIN a_pcr p ON b.sym = p.sym LEFT JOIN a_skew k ON b.sym = k.sym
LEFT JOIN a_short h ON b.sym = h.sym LEFT JOIN a_insider n ON b.sym = n.sym LEFT JOIN a_analyst a ON b.sym = a.sym
LEFT JOIN a_talk t ON b.sym = t.ticker"""
F["panel"] = f"""
SELECT n.*, x.* EXCLUDE (sym, dt, i), p.* EXCLUDE (sym, dt), g.* EXCLUDE (sym, dt), s.* EXCLUDE (sym, dt), c.regime, c.risk,
  c.exposure, c.health, h.bounce, v.vec,
  coalesce(a.pcr, 1) AS pcr, coalesce(a.iv_skew, 0) AS iv_skew, coalesce(a.short_change, 0) AS short_change,
  coalesce(a.short_float, 0) AS short_float, coalesce(a.insider, 0) AS insider, coalesce(a.analyst, 0) AS analyst,
  coalesce(a.mention_accel, 0) AS mention_accel,
  {L('n.MACD').replace('BY sym', 'BY n.sym').replace('BY dt', 'BY n.dt')} AS p_macd,
  {L('n.Signal_Line').replace('BY sym', 'BY n.sym').replace('BY dt', 'BY n.dt')} AS p_sig,
  {L('n.NR7').replace('BY sym', 'BY n.sym').replace('BY dt', 'BY n.dt')} AS p_nr7,
  {L('n.Inside_Bar').replace('BY sym', 'BY n.sym').replace('BY dt', 'BY n.dt')} AS p_in,
  {L('n.CVD_Trend').replace('BY sym', 'BY n.sym').replace('BY dt', 'BY n.dt')} AS p_cvd,
  {L('n.VPT_ZScore').replace('BY sym', 'BY n.sym').replace('BY dt', 'BY n.dt')} AS p_z
FROM ind n JOIN cross_feats x ON n.sym = x.sym AND n.dt = x.dt JOIN period_live p ON n.sym = p.sym AND n.dt = p.dt
JOIN gap_feats g ON n.sym = g.sym AND n.dt = g.dt JOIN stat_feats s ON n.sym = s.sym AND n.dt = s.dt
JOIN hour_feats h ON n.sym = h.sym AND n.dt = h.dt JOIN vecs v ON n.sym = v.sym AND n.dt = v.dt
LEFT JOIN alt a ON n.sym = a.sym AND n.dt = a.dt JOIN ctx c ON n.dt = c.dt"""
F["pan"] = "SELECT *, coalesce(p_macd < p_sig AND MACD > Signal_Line, false) AS crossed FROM panel WHERE i >= 59"


def sd(n: str, d: str, cap: int = 20) -> str:
    # least and greatest skip nulls, so a missing operand is tested first
    return f"CASE WHEN ({n}) / nullif({d}, 0) IS NULL THEN 0 ELSE greatest(least(({n}) / nullif({d}, 0), {cap}), -{cap}) END"


FACTORS = {
    "minervini": sd("SMA_50 - SMA_200", "SMA_200"), "rel_strength": "rs_20",
    "macd_cross": sd("MACD - Signal_Line", "abs(close) * 0.01e0"),
    "ttm_squeeze": sd("(KC_Upper - KC_Lower) - (BB_Upper - BB_Lower)", "ATR + 1e-10"),
    "ichimoku": sd("close - greatest(SenkouA, SenkouB)", "close * 0.01e0"),
    "pullback": sd("close - EMA_20", "EMA_20 * 0.01e0"), "cmf": "CMF", "gap": sd("open - pc", "pc * 0.01e0"),
    "vwap_break": sd("close - VWAP_20", "VWAP_20 * 0.01e0"), "avwap_break": sd("close - VWAP_20", "VWAP_20 * 0.01e0"),
    "fvg": f"CASE WHEN fvg_lower > 0 THEN {sd('close - fvg_lower', 'close * 0.01e0')} ELSE 0 END",
    "liquidity_sweep": sd("Swing_Low_20 - low", "low * 0.01e0"), "smart_money": "Smart_Money_Flow",
    "volume_stall": sd("volume", "Vol_MA20", 50), "wide_up_bar": sd("close - open", "open * 0.01e0"),
    "pocket_pivot": sd("volume", "Max_Down_Vol_10", 50), "vcp": sd("Range_20", "Range_60 + 1e-10"),
    "choch": sd("close - swing_high_10", "swing_high_10 * 0.01e0"),
    "order_block": sd("close - OB_Low", "OB_High - OB_Low + 1e-10"), "amd": sd("least(open, close) - low", "TR + 1e-10"),
    "weekly_resonance": "CAST(weekly_bullish AS INT)",
    "cvd": "CVD_Trend * CASE WHEN CVD_Divergence = 1 THEN 0.3e0 ELSE 1 END", "pure_alpha": "pure_alpha",
    "nr7": sd("Range", "ATR + 1e-10"), "vpt": "CASE WHEN VPT_Accel > 0 THEN 1 / (1 + exp(-VPT_ZScore)) ELSE 0 END",
    "beta": "beta_60d", "tlt_corr": "tlt_corr", "dxy_corr": "dxy_corr", "amihud": "Amihud", "vrp": "vrp",
    "cross_x_volume": sd("MACD - Signal_Line", "abs(close) * 0.01e0") + " * " + sd("volume", "Vol_MA20", 50),
    "cmf_x_smart": "CMF * Smart_Money_Flow", "surge_price_3d": "Recent_Price_Surge_3d",
    "surge_vol_3d": "Recent_Vol_Surge_3d", "weekly_x_daily_macd": "CAST(weekly_macd_res AND crossed AS INT)",
    "rsi_60m": "CAST(bounce AS INT)", "dist_52w": "Dist_52W_High", "monthly_flow": "CAST(monthly_inst_flow AS INT)", "pcr": "pcr",
    "iv_skew": "iv_skew", "short_change": "CASE WHEN short_float > 0.05e0 THEN short_change ELSE 0 END", "insider": "insider",
    "analyst": "analyst", "news_sentiment": "0", "mention_accel": "mention_accel", "kde": "kde_score", "fft": "fft_score",
    "hurst": "CASE WHEN hurst_sure AND hurst_med > 0.65e0 THEN greatest(0, least(1, (hurst_med - 0.5e0) * 2)) ELSE 0 END",
    **{f"alpha_t{k:02d}": f"vec[{k}]" for k in range(1, 17)},
}
_list = ", ".join(f"{{'f': '{k}', 'v': CAST(coalesce({v}, 0) AS DOUBLE)}}" for k, v in FACTORS.items())
SQL["factors_long"] = q(f"SELECT sym, dt, u.f AS factor, u.v AS value FROM (SELECT sym, dt, unnest([{_list}]) AS u FROM pan)",
                        "sym:i dt:d factor:s value:f")

BEAR, BULL = "regime IN ('bear', 'hidden_bear')", "regime IN ('bull', 'rebound')"
MULT = {
    "TREND": f"CASE WHEN {BEAR} THEN 0.6e0 WHEN {BULL} THEN 1.2e0 ELSE 1 END",
    "VOLATILITY": f"CASE WHEN {BEAR} THEN 0.6e0 WHEN {BULL} THEN 1.2e0 ELSE 1 END",
    "QUANTUM": f"CASE WHEN {BULL} THEN 1.2e0 ELSE 1 END", "REVERSAL": f"CASE WHEN {BEAR} THEN 1.4e0 ELSE 1 END",
    "SHORT": "1",
}
KW, BW = "(KC_Upper - KC_Lower)", "(BB_Upper - BB_Lower)"
ATRP, GAP, SPAN = "(ATR / (pc + 1e-10))", "((open - pc) / (pc + 1e-10))", "(high - low + 1e-10)"
STALL = "(volume > Vol_MA20 * 2 AND abs(close - open) < ATR * 0.5e0)"
ABSORB = ("(12 * (least(1, greatest(0, (CMF - 0.05e0) / 0.2e0)) * 0.6e0 + "
          "least(1, greatest(0, (Smart_Money_Flow - 0.1e0) / 0.4e0)) * 0.4e0))")
# tag, condition, points, theme, sub-theme ('' for none), in firing order; news is constant, as there is no source of it
TRIGGERS = [
    ("minervini", "close > SMA_50 AND SMA_50 > SMA_150 AND SMA_150 > SMA_200",
     "8 + trunc((SMA_50 - SMA_200) / (SMA_200 + 1e-10) * 20)", "TREND", ""),
    ("rel_strength", "rs_20 > 0 AND rs_20 > 1 + ATR / (close + 1e-10) * 2",
     "CASE WHEN volume / nullif(Vol_MA20, 0) > 1.5e0 AND close > open THEN 7 ELSE 4 END", "TREND", "MOMENTUM_BURST"),
    ("macd_cross", "crossed", "CASE WHEN MACD > 0 THEN 12 ELSE 8 END", "TREND", "MOMENTUM_BURST"),
    ("ichimoku", "Above_Cloud AND Tenkan > Kijun", "6", "TREND", ""),
    ("vwap_break", "close > VWAP_20 AND pc <= VWAP_20", "8", "TREND", "MOMENTUM_BURST"),
    ("avwap_break", "close > VWAP_20 AND pc <= VWAP_20", "12", "TREND", "MOMENTUM_BURST"),
    ("ttm_squeeze", f"{BW} < {KW}", f"8 + trunc(({KW} - {BW}) / (ATR + 1e-10) * 10)", "VOLATILITY", ""),
    ("nr7", "p_nr7 AND p_in AND close > ph", "12", "VOLATILITY", ""),
    ("vcp", f"Range_20 > 0 AND Range_20 < Range_60 * CASE WHEN {BEAR} THEN 0.4e0 ELSE 0.5e0 END AND close > SMA_50", "15", "VOLATILITY", ""),
    ("liquidity_sweep", "low < Swing_Low_20 AND close > Swing_Low_20", "15", "REVERSAL", "BOTTOM_REVERSAL"),
    ("choch", "low > Swing_Low_20 AND close > swing_high_10", "15", "REVERSAL", "BOTTOM_REVERSAL"),
    ("order_block", "low <= OB_High AND close >= OB_Low AND close > open", "15", "REVERSAL", "BOTTOM_REVERSAL"),
    ("kde", "kde_score > 0.5e0", "15 * kde_score", "QUANTUM", ""),
    ("hurst", "hurst_sure AND hurst_med > 0.65e0", "15 * (hurst_med - 0.5e0) * 2", "QUANTUM", ""),
    ("insider", "insider > 0.5e0", "20", "QUANTUM", ""),
    ("analyst", "analyst > 1.5e0", "8", "QUANTUM", ""),
    ("analyst", "analyst < -1.5e0", "-10", "TREND", ""),
    ("pure_alpha", "pure_alpha > 0.8e0", "22", "TREND", ""),
    ("pullback", "SuperTrend_Up AND close < EMA_20 + ATR * 0.5e0", "10", "REVERSAL", "BOTTOM_REVERSAL"),
    ("gap", f"{GAP} > {ATRP} * 0.5e0 AND {GAP} < {ATRP} * 2", "8", "VOLATILITY", ""),
    ("fvg", "fvg_lower > 0 AND low <= fvg_upper AND close > fvg_lower", "15", "REVERSAL", "BOTTOM_REVERSAL"),
    ("volume_stall", f"{STALL} AND close < Swing_Low_20 * 1.05e0", "12", "QUANTUM", ""),
    ("wide_up_bar", f"(close - open) / (open + 1e-10) * 100 > greatest(3, {ATRP} * 100 * 0.6e0) AND volume > Vol_MA20 * 1.5e0",
     "12", "QUANTUM", "PRICE_ACTION_BURST"),
    ("pocket_pivot", "close > pc AND volume > Max_Down_Vol_10 AND Max_Down_Vol_10 > 0 AND close >= EMA_50 AND pc <= EMA_50 * 1.02e0",
     "12", "REVERSAL", "BOTTOM_REVERSAL"),
    ("amd", f"close > open AND (open - low) / {SPAN} > 0.3e0 AND (high - close) / {SPAN} < 0.15e0", "12", "REVERSAL", ""),
    ("weekly_resonance", "weekly_bullish AND close > Highest_22 * 0.95e0", "20", "QUANTUM", ""),
    ("cvd", "CVD_Trend = 1 AND p_cvd <= 0 AND CVD_Divergence = 0", "12", "QUANTUM", "PRICE_ACTION_BURST"),
    ("vpt", "VPT_ZScore > 0.5e0 AND VPT_Accel > 0 AND p_z <= 0.5e0", "10", "TREND", "MOMENTUM_BURST"),
    ("cross_x_volume", "crossed", "12", "TREND", "MOMENTUM_BURST"),
    ("cmf_x_smart", f"CMF > 0.05e0 AND Smart_Money_Flow > 0.1e0 AND {ABSORB} > 3", ABSORB, "QUANTUM", "PRICE_ACTION_BURST"),
    ("fft", "fft_score >= 0.71e0", "15", "QUANTUM", ""),
    ("weekly_x_daily_macd", "weekly_macd_res AND crossed", "15", "TREND", ""),
    ("monthly_flow", "monthly_inst_flow", "10", "QUANTUM", ""),
    ("rsi_60m", "bounce", "8", "REVERSAL", "BOTTOM_REVERSAL"),
    ("beta", "beta_60d > 1.2e0", "CASE WHEN risk THEN -10 ELSE 7 END", "TREND", ""),
    ("tlt_corr", "abs(tlt_corr) > 0.4e0", "CASE WHEN tlt_corr > 0 THEN 8 ELSE 6 END", "TREND", ""),
    ("dxy_corr", "abs(dxy_corr) > 0.4e0", "CASE WHEN dxy_corr < 0 THEN 8 ELSE 6 END", "QUANTUM", ""),
    ("dist_52w", "coalesce(Dist_52W_High, 0) > -0.05e0 AND weekly_bullish", "10", "TREND", ""),
    ("amihud", "Amihud > 0.5e0 AND risk", "-10", "VOLATILITY", ""),
    ("vrp", "vrp > 0.25e0", "12", "QUANTUM", ""),
    ("mention_accel", "mention_accel > 20", "8", "VOLATILITY", ""),
    ("pcr", "pcr > 1.5e0", "15", "SHORT", ""),
    ("pcr", "pcr > 0 AND pcr < 0.5e0", "10", "QUANTUM", ""),
    ("iv_skew", "iv_skew > 0.08e0", "20", "SHORT", ""),
    ("iv_skew", "iv_skew < -0.05e0", "12", "QUANTUM", ""),
    ("short_change", "short_change > 0.1e0 AND short_float > 0.05e0 AND close > EMA_20", "15", "QUANTUM", ""),
    ("credit_risk", "risk", "15", "SHORT", ""),
]
_trig = ", ".join(
    f"{{'o': {k}, 'tag': '{t}', 'pts': CASE WHEN {c} THEN CAST(({p}) * ({MULT[th]}) AS DOUBLE) END, 'th': '{th}', 'sub': nullif('{s}', '')}}"
    for k, (t, c, p, th, s) in enumerate(TRIGGERS))
F["fired"] = f"""
SELECT sym, dt, u.o AS o, u.tag AS tag, u.pts AS pts, u.th AS theme, u.sub AS sub
FROM (SELECT sym, dt, unnest([{_trig}]) AS u FROM pan) WHERE u.pts IS NOT NULL"""
SQL["triggers_long"] = q("fired", "sym:i dt:d tag:s pts=points:f theme:s sub:s")
F["theme_pts"] = """
SELECT sym, dt, theme, sum(v) AS v FROM (
  SELECT sym, dt, theme, sub, CASE WHEN sub IS NULL THEN sum(pts) ELSE max(pts) + 0.3e0 * (sum(pts) - max(pts)) END AS v
  FROM fired GROUP BY sym, dt, theme, sub) GROUP BY sym, dt, theme"""
F["themes"] = """
SELECT p.sym, p.dt, any_value(p.RSI) AS rsi, any_value(coalesce(p.risk, false) OR p.pcr > 1.5e0 OR p.iv_skew > 0.08e0) AS veto,
  coalesce(max(v) FILTER (theme = 'TREND'), 0) AS t, coalesce(max(v) FILTER (theme = 'VOLATILITY'), 0) AS vo,
  coalesce(max(v) FILTER (theme = 'REVERSAL'), 0) AS re, coalesce(max(v) FILTER (theme = 'QUANTUM'), 0) AS qu,
  coalesce(max(v) FILTER (theme = 'SHORT'), 0) AS sh
FROM pan p LEFT JOIN theme_pts t ON p.sym = t.sym AND p.dt = t.dt GROUP BY p.sym, p.dt"""
_sat = " + ".join(f"CASE WHEN {c} > 0 THEN 50 * (1 - exp(-({c}) / 25e0)) ELSE 0 END" for c in (
    "CASE WHEN t > 40 THEN 40 + ln(1 + t - 40) * 10 ELSE t END", "vo", "re", "qu"))
F["scores"] = f"""
SELECT *, CAST(trunc(100 * (1 - exp(-({_sat}) / 50e0)) * CASE WHEN veto THEN 0.1e0 ELSE 1 END) AS BIGINT) AS base FROM themes"""
SQL["score_core"] = q("""SELECT s.*, CASE WHEN rsi > 85 THEN greatest(base - 30, 0) ELSE base END AS score,
    coalesce(n, 0) AS n, coalesce(tags, '') AS tags
  FROM scores s LEFT JOIN (SELECT sym, dt, count(*) AS n, string_agg(tag, ',' ORDER BY o) AS tags FROM fired GROUP BY 1, 2) f
  ON s.sym = f.sym AND s.dt = f.dt""",
                      "sym:i dt:d t=s_trend:f vo=s_volatility:f re=s_reversal:f qu=s_quantum:f sh=s_short:f veto:b score:i n=n_factors:i tags:s")

F["scored"] = f"""
SELECT s.sym, s.dt, s.veto, CASE WHEN s.rsi > 85 THEN greatest(base - 30, 0) ELSE base END AS score, p.close, p.ATR, p.Chandelier_Exit,
  p.SMA_200, p.exposure, p.health, p.vec, coalesce(f.n, 0) + CAST(coalesce(p.RSI > 85, false) AS INT)
    + CAST(coalesce({STALL} AND NOT coalesce(close < Swing_Low_20 * 1.05e0, false) AND close > swing_high_10 * 0.95e0, false) AS INT)
    + CAST(coalesce(CVD_Trend = 1 AND p_cvd <= 0 AND CVD_Divergence <> 0, false) AS INT) AS n_signals
FROM scores s JOIN pan p ON s.sym = p.sym AND s.dt = p.dt
LEFT JOIN (SELECT sym, dt, count(*) AS n FROM fired GROUP BY sym, dt) f ON s.sym = f.sym AND s.dt = f.dt"""
SQL["score_panel"] = q("scored", "sym:i dt:d close:f score:i veto:b n_signals:i")
SQL["asof_hourly"] = q("hour_feats", "sym:i dt:d rsi_60m:f bounce=rsi_60m_bounce:b")
SQL["feat_periods_live"] = q("period_live", "sym:i dt:d weekly_bullish:b weekly_macd_res:b monthly_inst_flow:b")
_v = [("kde", FACTORS["kde"]), ("fft", FACTORS["fft"]), ("hurst", FACTORS["hurst"]), ("rsi_60m", FACTORS["rsi_60m"]), ("pcr", "pcr"),
      ("insider", "insider"), ("alpha_t01", "vec[1]"), ("alpha_t16", "vec[16]")]
SQL["factor_vector"] = q(f"SELECT sym, dt, 64 AS n, {', '.join(f'{e} AS f_{k}' for k, e in _v)} FROM pan",
                         "sym:i dt:d n:i " + " ".join(f"f_{k}={k}:f" for k, _ in _v))
SQL["seq_tensor"] = q("seq_sums", "sym:i dt:d 60=n:i first_sum:f last_sum:f all_sum:f")
SQL["seq_scores"] = q("SELECT *, 0.5e0 + 0.4e0 * tanh(sqrt(list_inner_product(vec, vec)) / 4) AS p FROM vecs", "sym:i dt:d p=prob:f")

# --- the daily cross-section ----------------------------------------------------------------
F["sectors"] = """
SELECT s_suppkey AS sym, min(n_name) AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE n_nationkey <> 0 GROUP BY 1"""
F["view0"] = """
SELECT i.sym, i.dt, i.close, coalesce(i.ATR, i.close * 0.02e0) AS a, i.Chandelier_Exit AS ch, i.SMA_200 AS s200,
  (CAST(i.volume AS BIGINT) * 7 + i.sym * 13 + (i.dt - DATE '1995-01-01')) % 101 AS raw, e.soon,
  coalesce(s.sector, 'SP500_WILD') AS sector, c.exposure, c.health
FROM ind i JOIN soon e ON i.sym = e.sym AND i.dt = e.dt LEFT JOIN sectors s ON i.sym = s.sym JOIN ctx c ON i.dt = c.dt"""
F["view"] = """
SELECT *, close + a * 3.5e0 AS tp,
  greatest(close - a * 2, CASE WHEN coalesce(ch, 0) = 0 THEN close - a * 2 ELSE ch END) AS sl,
  0.45e0 + raw / 100e0 * 0.2e0 + CASE WHEN close > s200 THEN 0.03e0 ELSE 0 END AS prob,
  CASE WHEN soon AND raw > 0 THEN raw // 2 ELSE raw END AS score FROM view0"""
SQL["position_levels"] = q("view", "sym:i dt:d tp:f sl:f prob=adj_prob:f sector:s raw=raw_score:i score:i")
F["cuts"] = "SELECT dt, greatest(8, quantile_cont(raw, 0.85)) AS cut FROM view WHERE raw > 0 GROUP BY dt"
SQL["dynamic_cut"] = q("cuts", "dt:d cut:f")
F["crowded"] = """
SELECT sym, dt, sector, prob, close, exposure, CASE WHEN n >= 2 AND rn > 1 THEN CAST(trunc(score * pen) AS BIGINT) ELSE score END AS score
FROM (SELECT v.*, count(*) OVER (PARTITION BY v.dt, sector) AS n,
    row_number() OVER (PARTITION BY v.dt, sector ORDER BY score DESC, sym) AS rn,
    greatest(0.6e0, least(0.9e0, 0.75e0 * (1 + health * 0.3e0))) AS pen
  FROM view v JOIN cuts c ON v.dt = c.dt WHERE raw > 0 AND score >= cut)"""
SQL["sector_crowding"] = q("crowded", "sym:i dt:d sector:s score:i")
F["picks"] = """
SELECT *, greatest(0.02e0, least(0.12e0, (prob * 2.5e0 - 1) / 1.5e0 * 0.2e0)) AS w FROM (
  SELECT *, row_number() OVER (PARTITION BY dt ORDER BY prob * 100 + score DESC, sym) AS rank FROM crowded) WHERE rank <= 5"""
SQL["daily_top5"] = q("picks", "dt:d rank:i sym:i score:i prob=adj_prob:f w=opt_weight:f")
SQL["shadow_pool"] = q("""SELECT dt, sym, row_number() OVER (PARTITION BY dt ORDER BY md5('s|' || sym || '|' || CAST(dt AS VARCHAR)), sym) AS slot
  FROM view WHERE raw <= 0 QUALIFY slot <= 150""", "dt:d slot:i sym:i")
SQL["size_orders"] = q("""SELECT 'Q_' || substr(md5(sym || '|' || CAST(dt AS VARCHAR)), 1, 8) AS oid, sym, dt,
    100000e0 * exposure * w / close AS qty, close * 1.002e0 AS lim, close, 'PENDING_SUBMIT' AS status FROM picks""",
                       "oid=client_oid:s sym=symbol:i dt:d qty:f round(lim,2)=limit_price:f close=arrival_price:f status:s")

# the same cross-section on the score and the model's probability
F["real_view0"] = """
SELECT i.sym, i.dt, i.close, coalesce(i.ATR, i.close * 0.02e0) AS a, i.Chandelier_Exit AS ch, i.SMA_200 AS s200, i.score AS raw, e.soon,
  coalesce(s.sector, 'SP500_WILD') AS sector, i.exposure, i.health, i.n_signals,
  0.5e0 + 0.4e0 * tanh(sqrt(list_inner_product(vec, vec)) / 4) AS p0
FROM scored i JOIN soon e ON i.sym = e.sym AND i.dt = e.dt LEFT JOIN sectors s ON i.sym = s.sym"""
F["real_view"] = F["view"].replace("view0", "real_view0").replace("0.45e0 + raw / 100e0 * 0.2e0", "p0")
F["real_cuts"] = F["cuts"].replace("FROM view", "FROM real_view")
F["real_crowded"] = F["crowded"].replace("FROM view v JOIN cuts c", "FROM real_view v JOIN real_cuts c").replace(
    "SELECT sym, dt, sector, prob,", "SELECT sym, dt, sector, raw, tp, sl, n_signals + CAST(soon AND raw > 0 AS INT) AS n_signals, prob,")
F["real_picks"] = F["picks"].replace("FROM crowded", "FROM real_crowded")
SQL["daily_scan"] = q("real_picks", "dt:d rank:i sym:i raw=raw_score:i score:i prob=adj_prob:f tp:f sl:f sector:s w=opt_weight:f n_signals:i")

# --- backtest -------------------------------------------------------------------------------
_tags = ", ".join(f"CASE WHEN (sym * 31 + idx * 17 + {k * k * 7}) % {k + 2} = 0 THEN '{t}' END" for k, t in enumerate(
    ("fft", "hurst", "vpt", "cvd", "kde", "amihud", "vrp", "macd_cross"), 1))
F["sig"] = f"""
SELECT idx * 10000000 + sym AS sig_id, sym, dt, idx, ((sym * 7919 + idx * 104729) % 1000) / 1000e0 AS prob,
  list_filter([{_tags}], lambda x: x IS NOT NULL) AS tags
FROM (SELECT b.*, c.idx, lag(close) OVER (PARTITION BY sym ORDER BY b.dt) AS prev FROM bars_wild b JOIN cal_wild c ON b.dt = c.dt)
WHERE close > prev * 1.02e0"""


def trade_sql(bars: str) -> str:
    return f"""
SELECT *, (x * (1 - 0.003e0 - 0.0005e0) - cost) / (cost + 1e-10) * half AS ret, (h - cost) / cost AS mfe, (l - cost) / cost AS mae FROM (
  SELECT s.sig_id, s.sym, s.dt, s.idx, s.prob, s.tags, d AS horizon, e.open * (1 + CASE WHEN e.open / z.close - 1 > 0.03e0 THEN 0.009e0 ELSE 0.003e0 END + 0.0005e0) AS cost,
    CASE WHEN e.open / z.close - 1 > 0.03e0 THEN 0.5e0 ELSE 1 END AS half, x.close AS x,
    CASE d WHEN 1 THEN z.h1 WHEN 3 THEN z.h3 ELSE z.h5 END AS h, CASE d WHEN 1 THEN z.l1 WHEN 3 THEN z.l3 ELSE z.l5 END AS l
  FROM asked s
  JOIN {bars} z ON z.sym = s.sym AND z.idx = s.idx
  JOIN {bars} e ON e.sym = s.sym AND e.idx = s.i1
  JOIN {bars} x ON x.sym = s.sym AND x.idx = s.i2 WHERE e.open > 0)"""


_ext = ", ".join(
    f"{f}({c}) OVER (PARTITION BY sym ORDER BY idx RANGE BETWEEN 1 FOLLOWING AND {k} FOLLOWING) AS {c[0]}{k}"
    for k in (1, 3, 5) for f, c in (("max", "high"), ("min", "low")))
F["priced_wild"] = f"SELECT *, {_ext} FROM (SELECT b.*, c.idx FROM bars_wild b JOIN cal_wild c ON b.dt = c.dt)"
F["asked"] = """
SELECT *, least(idx + 1, (SELECT max(idx) FROM cal_wild)) AS i1, least(idx + d, (SELECT max(idx) FROM cal_wild)) AS i2
FROM sig, (SELECT unnest([1, 3, 5]) AS d)"""
F["trades"] = trade_sql("priced_wild")
SQL["bt_returns"] = q("trades", "sig_id:i sym:i dt:d idx:i horizon:i ret:f")
SQL["bt_mfe_mae"] = q("trades", "sig_id:i horizon:i mfe:f mae:f")
_pf = "CASE WHEN count(*) FILTER (ret < 0) > 0 THEN coalesce(sum(ret) FILTER (ret > 0), 0) / -sum(ret) FILTER (ret < 0) ELSE 99 END"
F["stats"] = f"""
SELECT horizon, avg(CAST(ret > 0 AS INT)) AS win_rate, avg(ret) AS avg_ret, avg(ret) / (stddev_pop(ret) + 1e-10) AS sharpe,
  min(ret) AS worst_trade, count(*) AS total_trades, {_pf} AS profit_factor, coalesce(avg(mae) FILTER (ret > 0), 0) AS avg_win_mae,
  avg(CAST(ret > 0 AS INT)) FILTER (prob >= 0.5e0 AND horizon = 3) AS ai_win_rate FROM trades GROUP BY horizon"""
SQL["bt_stats"] = q("stats", "horizon:i win_rate:f avg_ret:f sharpe:f worst_trade:f total_trades:i profit_factor:f avg_win_mae:f ai_win_rate:f")
SQL["bt_streak"] = q("""SELECT horizon, max(c) AS c FROM (SELECT horizon, island, count(*) FILTER (ret < 0) AS c FROM (
    SELECT horizon, ret, sum(CASE WHEN ret >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY horizon ORDER BY dt, sig_id) AS island FROM trades)
  GROUP BY horizon, island) GROUP BY horizon""", "horizon:i c=max_cons_loss:i")
SQL["bt_factor_stats"] = q(f"""SELECT factor, avg(CAST(ret > 0 AS INT)) AS win_rate, avg(ret) AS avg_ret, count(*) AS n, {_pf} AS pf
  FROM (SELECT unnest(tags) AS factor, ret FROM trades WHERE horizon = 3) GROUP BY factor HAVING count(*) >= 2""",
                           "factor:s win_rate:f avg_ret:f n:i pf=profit_factor:f")
SQL["bt_from_log"] = SQL["bt_factor_stats"]
F["attr"] = """
SELECT factor, coalesce((median(ret) FILTER (flag = 1) - median(ret) FILTER (flag = 0)) * 10000, 0) AS prem,
  coalesce(covar_pop(flag, base) / nullif(stddev_pop(flag) * stddev_pop(base), 0), 0) AS c, avg(flag) AS rate
FROM (SELECT ret, factor, CAST(list_contains(tags, factor) AS INT) AS flag, CAST(list_contains(tags, 'macd_cross') AS INT) AS base
  FROM trades, (SELECT unnest(['fft', 'hurst', 'vpt', 'cvd', 'kde', 'amihud', 'vrp']) AS factor) WHERE horizon = 3)
GROUP BY factor HAVING count(*) >= 30"""
SQL["bt_attribution"] = q("""SELECT *, CASE WHEN prem < 0 THEN 'negative premium' WHEN c > 0.6e0 THEN 'highly coupled'
  WHEN prem > 50 AND c < 0.4e0 THEN 'pure alpha' ELSE 'useful gain' END AS diagnosis FROM attr""",
                          "factor:s prem=premium_bps:f c=corr_with_baseline:f rate=trigger_rate:f diagnosis:s")
SQL["bt_headline"] = q("stats", "win_rate:f profit_factor:f ai_win_rate:f", "WHERE horizon = 3")

F["w_sums"] = seq_sums("w_seq_rows")
F["smp_all"] = """
SELECT t.sig_id, t.sym, t.dt, s.all_sum, t.ret, count(*) OVER () AS n
FROM trades t JOIN w_sums s ON t.sym = s.sym AND t.dt = s.dt WHERE t.horizon = 3 AND s.i >= 59"""
SQL["train_samples"] = q("smp_all", "sig_id:i sym:i dt:d all_sum=total:f ret=label:f", "WHERE n >= 64")

# --- factor evaluation ----------------------------------------------------------------------
F["cal"] = "SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS idx FROM (SELECT DISTINCT dt FROM bars)"
F["priced"] = "SELECT b.*, c.idx FROM bars b JOIN cal c ON b.dt = c.dt"
F["fwd"] = """
SELECT s.sym, s.dt, round((x.close * (1 - 0.003e0 - 0.0005e0) - cost) / (cost + 1e-10) * half, 10) AS ret FROM (
  SELECT z.sym, z.dt, z.idx, m.top, e.open * (1 + CASE WHEN e.open / z.close - 1 > 0.03e0 THEN 0.009e0 ELSE 0.003e0 END + 0.0005e0) AS cost,
    CASE WHEN e.open / z.close - 1 > 0.03e0 THEN 0.5e0 ELSE 1 END AS half
  FROM priced z CROSS JOIN (SELECT max(idx) AS top FROM cal) m JOIN priced e ON e.sym = z.sym AND e.idx = least(z.idx + 1, m.top)) s
JOIN priced x ON x.sym = s.sym AND x.idx = least(s.idx + 3, s.top)"""
_ic = ", ".join(f"{{'f': '{k}', 'v': round(CAST(coalesce({v}, 0) AS DOUBLE), 8)}}" for k, v in FACTORS.items())
F["ic_in"] = f"""
SELECT i.dt, u.f AS factor, u.v AS value, ret FROM (SELECT sym, dt, unnest([{_ic}]) AS u FROM pan) i
JOIN fwd ON i.sym = fwd.sym AND i.dt = fwd.dt"""
F["ic"] = """
SELECT dt, factor, CASE WHEN stddev_pop(value) < 1e-6 THEN 0 ELSE
  coalesce(covar_pop(rf, rr) / nullif(stddev_pop(rf) * stddev_pop(rr), 0), 0) END AS ic
FROM (SELECT *, rank() OVER (PARTITION BY dt, factor ORDER BY value) + (count(*) OVER (PARTITION BY dt, factor, value) - 1) / 2e0 AS rf,
    rank() OVER (PARTITION BY dt, factor ORDER BY ret) + (count(*) OVER (PARTITION BY dt, factor, ret) - 1) / 2e0 AS rr FROM ic_in)
GROUP BY dt, factor HAVING count(*) >= 5 AND stddev_pop(ret) >= 1e-6"""
SQL["ic_daily"] = q("ic", "dt:d factor:s ic:f")
F["ic_sum"] = """
SELECT factor, count(*) AS n, CASE WHEN count(*) > 5 THEN avg(ic) ELSE 0 END AS m,
  CASE WHEN count(*) > 5 THEN avg(ic) / (stddev_pop(ic) + 1e-10) ELSE 0 END AS ir,
  CASE WHEN count(*) > 5 THEN avg(ic) / ((stddev_pop(ic) + 1e-10) / sqrt(count(*))) ELSE 0 END AS t FROM ic GROUP BY factor"""
SQL["ic_summary"] = q("ic_sum", "factor:s n=n_days:i m=mean_ic:f ir:f t=t_stat:f")
SQL["factor_select"] = q("""SELECT *, abs(t) > 1 AS active, row_number() OVER (ORDER BY abs(t) DESC, factor) AS rank,
    sum(CAST(abs(t) > 1 AS INT)) OVER () AS k FROM ic_sum
  QUALIFY (abs(t) > 1 AND k >= 5) OR (k < 5 AND rank <= 5)""", "factor:s rank:i active:b")

# --- learning -------------------------------------------------------------------------------
F["t3"] = """
SELECT *, row_number() OVER (ORDER BY dt, sig_id) - 1 AS pos, count(*) OVER () AS n FROM trades WHERE horizon = 3"""
SQL["purged_split"] = q("""SELECT sig_id, pos, CASE WHEN pos < e THEN 'train' WHEN pos >= s THEN 'valid' ELSE 'embargo' END AS part FROM (
    SELECT *, CASE WHEN short THEN floor(n * 0.8e0) ELSE floor(n * 0.75e0) END AS e,
      CASE WHEN short THEN floor(n * 0.8e0) ELSE floor(n * 0.75e0) + 60 END AS s
    FROM (SELECT *, floor(n * 0.75e0) + 60 >= n - 10 AS short FROM t3))""", "sig_id:i pos=idx:i part:s")
SQL["ts_folds"] = q("""SELECT sig_id, pos, CASE WHEN pos < n - 3 * (n // 4) THEN 0 ELSE (pos - (n - 3 * (n // 4))) // (n // 4) + 1 END AS fold
  FROM t3""", "sig_id:i pos=idx:i fold:i")
SQL["class_weights"] = q("""SELECT sig_id, ret > 0.015e0 AS label, n / (2e0 * count(*) OVER (PARTITION BY ret > 0.015e0)) AS w FROM t3""",
                         "sig_id:i label:b w=weight:f")
F["smp"] = """
SELECT *, row_number() OVER (ORDER BY CASE cls WHEN 1 THEN 0 WHEN -1 THEN 1 ELSE 2 END, h, id) - 1 AS slot FROM (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, CASE label % 3 WHEN 2 THEN 1 WHEN 0 THEN -1 ELSE 0 END AS cls,
    CAST('0x' || substr(md5('t|' || vec_id), 1, 8) AS BIGINT) AS h FROM embeddings)"""
F["drawn"] = """
SELECT s.*, CASE WHEN cls = 1 THEN np + slot % nn WHEN cls = -1 THEN (slot - np) % np ELSE (slot - np - nn) % (np + nn) END AS neg_slot
FROM smp s CROSS JOIN (SELECT count(*) FILTER (cls = 1) AS np, count(*) FILTER (cls = -1) AS nn FROM smp)"""
_u = "((CAST('0x' || substr(md5('t{0}|' || id || '|' || (k - 1)), 1, 8) AS BIGINT) + 1) / 4294967297e0)"
F["noisy"] = f"""
SELECT *, list_transform(vec, lambda x, k: x + 0.02e0 * sqrt(-2 * ln({_u.format(1)})) * cos({_u.format(2)} * 2 * pi())) AS moved FROM drawn"""
SQL["triplet_loss"] = q("""SELECT *, ln(1 + exp(neg - pos)) AS loss FROM (
    SELECT a.id, a.cls, b.id AS neg_id, list_cosine_similarity(a.vec, b.vec) / 0.1e0 AS neg, list_cosine_similarity(a.vec, a.moved) / 0.1e0 AS pos
    FROM noisy a JOIN smp b ON a.neg_slot = b.slot)""", "id:i cls:i neg_id:i neg=neg_sim:f pos=pos_sim:f loss:f")
SQL["embed_confidence"] = q("""SELECT vec_id, 0.5e0 + 0.4e0 * tanh(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) / 4) AS p
  FROM embeddings""", "vec_id:i p=prob:f")

# --- scenarios ------------------------------------------------------------------------------
F["parts"] = """
SELECT a.sym, a.dt, a.open, a.high, a.low, a.close,
  sum(CASE WHEN b.i = 0 THEN 1 ELSE 1e0/3e0 END * b.close * pow(2e0/3e0, a.i - b.i)) AS e5
FROM i0 a JOIN i0 b ON a.sym = b.sym AND b.i BETWEEN a.i - 120 AND a.i GROUP BY ALL"""
F["trend"] = f"""
SELECT sym, dt, pow({1 - 2 / 61!r}e0, i) * sum(CASE WHEN i = 0 THEN 1 ELSE {2 / 61!r}e0 END * close * pow({1 - 2 / 61!r}e0, -i))
  OVER (PARTITION BY sym ORDER BY dt ROWS UNBOUNDED PRECEDING) AS tr FROM i0"""
F["split"] = """
SELECT p.*, t.tr, p.e5 - t.tr AS sea, p.close - p.e5 AS res FROM parts p JOIN trend t ON p.sym = t.sym AND p.dt = t.dt"""
SQL["scen_decompose"] = q("split", "sym:i dt:d tr=trend:f sea=seasonal:f res=residual:f")
SQL["scen_noise"] = q("SELECT *, tr + sea + res * 1.5e0 AS c2, (tr + sea + res * 1.5e0) / (close + 1e-10) AS k FROM split",
                      "sym:i dt:d open*k=open:f high*k=high:f low*k=low:f c2=close:f")

F["turned"] = """
SELECT s.sym, k, n, CASE WHEN k = 0 OR 2 * k = n THEN 0 ELSE CAST('0x' || substr(md5(s.sym || '|' || k), 1, 8) AS BIGINT) * 2 * pi() / 4294967296e0 END AS turn,
  sum(sea * cos(2 * pi() * ((k * i) % n) / n)) AS re, -sum(sea * sin(2 * pi() * ((k * i) % n) / n)) AS im
FROM (SELECT split.*, row_number() OVER (PARTITION BY sym ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY sym) AS n FROM split) s,
  (SELECT unnest(range(0, 2000)) AS k) f WHERE 2 * k <= n GROUP BY s.sym, k, n"""
F["phase"] = """
SELECT s.sym, s.dt, s.open, s.high, s.low, s.close, s.tr + s.res + w.x AS c2 FROM split s JOIN (
  SELECT p.sym, p.dt, sum((CASE WHEN k = 0 OR 2 * k = t.n THEN 1 ELSE 2 END) * (re * cos(turn + 2 * pi() * ((k * i) % t.n) / t.n)
    - im * sin(turn + 2 * pi() * ((k * i) % t.n) / t.n)) / t.n) AS x
  FROM (SELECT sym, dt, row_number() OVER (PARTITION BY sym ORDER BY dt) - 1 AS i FROM split) p JOIN turned t ON p.sym = t.sym
  GROUP BY p.sym, p.dt) w ON s.sym = w.sym AND s.dt = w.dt"""
SQL["scen_phase"] = q("SELECT *, c2 / (close + 1e-10) AS k FROM phase", "sym:i dt:d open*k=open:f high*k=high:f low*k=low:f c2=close:f")

# --- orders ---------------------------------------------------------------------------------
F["evt"] = """
SELECT user_id AS oid, event_id AS seq, ts, value AS price,
  CASE event_type WHEN 'signup' THEN 'PENDING_SUBMIT' WHEN 'purchase' THEN 'FILLED' WHEN 'error' THEN 'REJECTED' ELSE 'OPEN' END AS status,
  CASE WHEN event_type = 'click' THEN event_id END AS boid FROM events"""
F["last_evt"] = """
SELECT *, max(boid) OVER (PARTITION BY oid) AS broker, count(*) OVER (PARTITION BY oid) AS n FROM evt
QUALIFY row_number() OVER (PARTITION BY oid ORDER BY CASE WHEN status IN ('FILLED', 'REJECTED') THEN seq ELSE 1000000000000 - seq END) = 1"""
SQL["order_latest"] = q("last_evt", "oid=client_oid:i status:s price:f seq:i broker=broker_oid:i n=n_events:i")
F["ords"] = "SELECT user_id AS oid, CASE WHEN user_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, arg_min(value, event_id) AS arr FROM events GROUP BY 1"
F["tca"] = """
SELECT l.oid, o.side, o.arr, l.price, l.ts, abs(l.price - o.arr) / (o.arr + 1e-10) * 10000 * CASE WHEN side = 'SELL' THEN -1 ELSE 1 END AS bps
FROM last_evt l JOIN ords o ON l.oid = o.oid WHERE l.status = 'FILLED'"""
SQL["tca_slippage"] = q("tca", "oid=client_oid:i side:s arr=arrival_price:f price=execution_price:f bps=slippage_bps:f")


def hist(src: str, x: str, by: str, bins: int) -> str:
    return f"""SELECT floor({x} / step) * step AS bin, {by} count(*) AS n FROM {src} CROSS JOIN (
  SELECT u * CASE WHEN raw / u <= 1 THEN 1 WHEN raw / u <= 2 THEN 2 WHEN raw / u <= 5 THEN 5 ELSE 10 END AS step FROM (
    SELECT raw, pow(10e0, floor(log10(raw))) AS u FROM (SELECT (max({x}) - min({x})) / {bins}e0 AS raw FROM {src}))) GROUP BY ALL"""


SQL["tca_hist"] = q(hist("tca", "bps", "side,", 30), "bin:f side:s n:i")
SQL["prob_hist"] = q(hist("sig", "prob", "", 25), "bin:f n:i")
SQL["tca_latest25"] = q("SELECT * FROM tca ORDER BY ts DESC, oid LIMIT 25", "oid=client_oid:i ts=timestamp:t bps=slippage_bps:f")

# --- flagship -------------------------------------------------------------------------------
SQL["stacked_averages"] = q("""SELECT *, (SMA_50 - SMA_200) / SMA_200 AS strength FROM (
    SELECT * FROM ind QUALIFY row_number() OVER (PARTITION BY sym ORDER BY dt DESC) = 1)
  WHERE close > SMA_50 AND SMA_50 > SMA_150 AND SMA_150 > SMA_200""", "sym:i dt:d close:f strength:f")

__all__ = ["SQL"]
