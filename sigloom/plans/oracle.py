"""Independent SQL for the registered queries, over the raw tables, in DuckDB's dialect.

``FRAGMENTS`` are named sub-queries; ``compose`` pulls in the ones a statement mentions. Nothing
here is shared with the Spark side: averages are closed-form sums, frames are plain SQL frames.
"""

from __future__ import annotations

import re

F: dict[str, str] = {}


def rows(n: int, end: str = "CURRENT ROW") -> str:
    return f"(PARTITION BY sym ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND {end})"


def R(agg: str, x: str, n: int, m: int | None = None, lead: int = 0) -> str:
    return f"CASE WHEN i >= {(m or n) - 1 + lead} THEN {agg}({x}) OVER {rows(n)} END"


def L(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY sym ORDER BY dt)"


def prior(agg: str, x: str, n: int, need: int) -> str:
    return (f"CASE WHEN i >= {need} THEN {agg}({x}) OVER (PARTITION BY sym ORDER BY dt ROWS BETWEEN "
            f"{n} PRECEDING AND 1 PRECEDING) END")


def E(x: str, alpha: float) -> str:
    q = f"{1 - alpha!r}e0"
    return (f"pow({q}, i) * sum(CASE WHEN i = 0 THEN 1e0 ELSE {alpha!r}e0 END * ({x}) * pow({q}, -i)) "
            f"OVER (PARTITION BY sym ORDER BY dt ROWS UNBOUNDED PRECEDING)")


def span(n: int) -> float:
    return 2.0 / (n + 1)


def ticks(scale: str) -> str:
    return f"""
SELECT l_suppkey AS sym, CAST(l_shipdate AS DATE) AS dt, l_orderkey * 8 + l_linenumber AS seq,
  l_quantity AS q, l_tax AS tax,
  100e0 * exp({scale} * CAST(sum(CAST(round((l_discount - 0.05e0) * 100) AS BIGINT)) OVER (
    PARTITION BY l_suppkey ORDER BY CAST(l_shipdate AS DATE), l_orderkey * 8 + l_linenumber, l_partkey
    ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 100e0) AS px
FROM lineitem"""


def bars_of(t: str) -> str:
    return f"""
SELECT sym, dt, open, greatest(h0, open) AS high, least(l0, open) AS low, close, volume FROM (
  SELECT sym, dt, arg_min(px * (1 + (tax - 0.04e0) / 10), seq) AS open, max(px * (1 + tax / 10)) AS h0,
    min(px * (1 - tax / 10)) AS l0, arg_max(px, seq) AS close, sum(q) AS volume
  FROM {t} GROUP BY sym, dt)"""


F["ticks_calm"], F["ticks_wild"] = ticks("0.4e0"), ticks("1.2e0")
F["bars"], F["bars_wild"] = bars_of("ticks_calm"), bars_of("ticks_wild")
F["macro"] = """
SELECT (['QQQ','SPY','TLT','DXY','HYG','IEI','VIX'])[k] AS series, dt,
  100e0 * exp(0.05e0 * CAST(sum(s) OVER (PARTITION BY k ORDER BY dt) AS DOUBLE) / 100e0)
    * CASE WHEN k = 7 THEN 0.18e0 ELSE 1e0 END AS close
FROM (SELECT l_linenumber AS k, CAST(l_shipdate AS DATE) AS dt,
        sum(CAST(round((l_discount - 0.05e0) * 100) AS BIGINT)) AS s
      FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7 GROUP BY 1, 2)"""
F["hours"] = """
SELECT user_id AS sym, date_trunc('hour', ts) AS dt, arg_min(value, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS open,
  max(value) AS high, min(value) AS low, arg_max(value, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS close,
  CAST(count(*) AS DOUBLE) AS volume
FROM events GROUP BY 1, 2"""
RESAMPLE = """
SELECT sym, p AS dt, arg_min(open, dt) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, dt) AS close, sum(volume) AS volume
FROM (SELECT *, {p} AS p FROM bars) GROUP BY sym, p"""
F["weeks"] = RESAMPLE.format(p="CAST(date_trunc('week', dt) AS DATE) + 6")
F["months"] = RESAMPLE.format(p="last_day(dt)")
F["cal_wild"] = "SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS idx FROM (SELECT DISTINCT dt FROM bars_wild)"

# --- indicators -------------------------------------------------------------------------------
F["i0"] = f"""
SELECT *, {L('close')} AS pc, {L('high')} AS ph, {L('low')} AS pl,
  row_number() OVER (PARTITION BY sym ORDER BY dt) - 1 AS i FROM bars"""
F["i1"] = f"""
SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
  (close - pc) / pc AS ret,
  (close - low - (high - close)) / greatest(high - low, 1e-10) AS clv,
  close * volume AS dv,
  CASE WHEN close > pc THEN close - pc ELSE 0 END AS gain,
  CASE WHEN close < pc THEN pc - close ELSE 0 END AS loss,
  CASE WHEN close < pc THEN volume ELSE 0 END AS downv,
  {R('avg', 'volume', 20)} AS vol20,
  sum(volume * (close - open) / (high - low + 1e-10)) OVER (PARTITION BY sym ORDER BY dt ROWS UNBOUNDED PRECEDING) AS cvd_raw,
  {E('close', span(12))} - {E('close', span(26))} AS macd,
  {E('close', span(20))} AS ema20, {E('close', span(50))} AS ema50
FROM i0"""
F["cvd"] = """
SELECT a.sym, a.dt, sum(b.cvd_raw * pow(2e0/3e0, a.i - b.i)) / 3e0 / (1 - pow(2e0/3e0, a.i + 1)) AS cvd
FROM i1 a JOIN i1 b ON a.sym = b.sym AND b.i BETWEEN a.i - 120 AND a.i GROUP BY a.sym, a.dt, a.i"""
F["i2"] = f"""
SELECT i1.*, cvd.cvd, {E('macd', span(9)).replace('PARTITION BY sym ORDER BY dt', 'PARTITION BY i1.sym ORDER BY i1.dt')} AS sig,
  sum(coalesce(ret, 0) * volume) OVER (PARTITION BY i1.sym ORDER BY i1.dt ROWS UNBOUNDED PRECEDING) AS vpt,
  coalesce(close > pc * 1.04e0 AND volume > vol20, false) AS surge
FROM i1 JOIN cvd ON i1.sym = cvd.sym AND i1.dt = cvd.dt"""
F["i3"] = f"""
SELECT *, {R('max', 'high', 9)} AS h9, {R('min', 'low', 9)} AS l9, {R('max', 'high', 26)} AS h26,
  {R('min', 'low', 26)} AS l26, {R('max', 'high', 52)} AS h52, {R('min', 'low', 52)} AS l52,
  {R('avg', 'tr', 20)} AS tr20, {R('avg', 'close', 20)} AS bbm, {R('stddev_samp', 'close', 20)} AS bbs,
  {R('avg', 'vpt', 50)} AS vptm, {R('stddev_samp', 'vpt', 50)} AS vpts,
  {R('max', 'high', 20)} AS h20, {R('avg', 'cvd', 10)} AS cvd10, {R('avg', 'cvd', 30)} AS cvd30,
  {R('max', 'cvd', 20)} AS cvdtop, {R('max', 'high', 252, 20)} AS h252, {R('max', 'high', 22)} AS h22,
  CASE WHEN surge THEN ph END AS oh, CASE WHEN surge THEN pl END AS ol
FROM i2"""
F["i4"] = """
SELECT *, (vpt - vptm) / CASE WHEN vpts IS NULL OR vpts = 0 THEN 1e-6 ELSE vpts END AS z,
  (h9 + l9) / 2 AS tenkan, (h26 + l26) / 2 AS kijun, (h52 + l52) / 2 AS mid52 FROM i3"""
F["ind"] = f"""
SELECT sym, dt, open, high, low, close, volume, i, pc, ph, pl,
  {R('avg', 'close', 50, 10)} AS SMA_50, {R('avg', 'close', 150, 30)} AS SMA_150,
  {R('avg', 'close', 200, 40)} AS SMA_200, ema20 AS EMA_20, ema50 AS EMA_50,
  100 - 100 / (1 + ({E('gain', 1 / 14)}) / ({E('loss', 1 / 14)} + 1e-10)) AS RSI,
  macd AS MACD, sig AS Signal_Line, tr AS TR, {R('avg', 'tr', 14)} AS ATR,
  ema20 + 1.5e0 * tr20 AS KC_Upper, ema20 - 1.5e0 * tr20 AS KC_Lower,
  bbm + 2 * bbs AS BB_Upper, bbm - 2 * bbs AS BB_Lower, tenkan AS Tenkan, kijun AS Kijun,
  {L('(tenkan + kijun) / 2', 26)} AS SenkouA, {L('mid52', 26)} AS SenkouB,
  coalesce(close > greatest({L('(tenkan + kijun) / 2', 26)}, {L('mid52', 26)}), false) AS Above_Cloud,
  close > ema20 AS SuperTrend_Up,
  CASE WHEN i >= 19 THEN greatest(least(({R('sum', 'clv * dv', 20)}) / (({R('sum', 'dv', 20)}) + 1e-10), 1), -1) ELSE 0 END AS CMF,
  high - low AS Range, coalesce(high - low <= {R('min', 'high - low', 7)}, false) AS NR7,
  coalesce(high <= ph AND low >= pl, false) AS Inside_Bar, vpt AS VPT_Cum, z AS VPT_ZScore,
  coalesce(coalesce(z, 0) - lag(coalesce(z, 0)) OVER (PARTITION BY sym ORDER BY dt), 0) AS VPT_Accel,
  ({R('sum', '(high + low + close) / 3 * volume', 20)}) / (({R('sum', 'volume', 20)}) + 1e-10) AS VWAP_20,
  {prior('max', 'downv', 10, 10)} AS Max_Down_Vol_10,
  last_value(oh IGNORE NULLS) OVER {rows(21)} AS OB_High, last_value(ol IGNORE NULLS) OVER {rows(21)} AS OB_Low,
  {prior('min', 'low', 20, 20)} AS Swing_Low_20,
  {R('max', 'high', 60)} - {R('min', 'low', 60)} AS Range_60, h20 - {R('min', 'low', 20)} AS Range_20,
  h20 AS Price_High_20, vol20 AS Vol_MA20, cvd AS CVD_Smooth,
  CASE WHEN cvd10 > cvd30 THEN 1e0 ELSE -1e0 END AS CVD_Trend,
  CASE WHEN close >= h20 * 0.99e0 AND cvd < cvdtop * 0.95e0 THEN 1 ELSE 0 END AS CVD_Divergence,
  h22 AS Highest_22, {R('avg', 'tr', 22)} AS ATR_22, h22 - 2.5e0 * {R('avg', 'tr', 22)} AS Chandelier_Exit,
  {R('avg', 'clv', 10)} AS Smart_Money_Flow,
  {prior('max', 'close / open - 1', 3, 3)} * 100 AS Recent_Price_Surge_3d,
  {prior('max', 'volume / (vol20 + 1)', 3, 22)} AS Recent_Vol_Surge_3d,
  {R('avg', 'abs(ret) / (dv + 1e-10)', 20, 20, 1)} * 1e6 AS Amihud,
  (close - h252) / (h252 + 1e-10) AS Dist_52W_High
FROM i4"""

# --- market context ---------------------------------------------------------------------------
F["regimes"] = """
SELECT dt, close, sma50, sma200, trend20, CASE WHEN n < 200 THEN 'range'
    WHEN (trend20 < -0.04e0 OR close < sma50) AND close > sma200 THEN 'hidden_bear'
    WHEN (trend20 < -0.04e0 OR close < sma50) AND trend20 < -0.02e0 THEN 'bear'
    WHEN trend20 < -0.04e0 OR close < sma50 THEN 'rebound'
    WHEN close > sma200 AND trend20 > 0.02e0 THEN 'bull' ELSE 'range' END AS regime
FROM (SELECT *, CASE WHEN n >= 50 THEN avg(close) OVER (ORDER BY dt ROWS 49 PRECEDING) END AS sma50,
        CASE WHEN n >= 200 THEN avg(close) OVER (ORDER BY dt ROWS 199 PRECEDING) END AS sma200
      FROM (SELECT dt, close, row_number() OVER (ORDER BY dt) AS n,
              close / lag(close, 19) OVER (ORDER BY dt) - 1 AS trend20 FROM macro WHERE series = 'QQQ'))"""
F["vixes"] = """
SELECT dt, close AS vix, CASE WHEN close > 30 THEN 'extreme_fear' WHEN close > 25 THEN 'fear'
  WHEN close < 15 THEN 'calm' ELSE 'normal' END AS vix_band FROM macro WHERE series = 'VIX'"""
F["credit"] = """
SELECT dt, ratio, ratio / lag(ratio, 20) OVER (ORDER BY dt) - 1 AS mom FROM (
  SELECT dt, last_value(r IGNORE NULLS) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING) AS ratio FROM (
    SELECT coalesce(h.dt, e.dt) AS dt, h.close / e.close AS r
    FROM (SELECT * FROM macro WHERE series = 'HYG') h FULL JOIN (SELECT * FROM macro WHERE series = 'IEI') e ON h.dt = e.dt))"""
F["ctx"] = """
SELECT dt, regime, vix, mom, mom < -0.02e0 AS risk,
  CASE regime WHEN 'bear' THEN 0.3e0 WHEN 'hidden_bear' THEN 0.5e0 WHEN 'rebound' THEN 0.6e0 ELSE 1e0 END
    * CASE WHEN mom < -0.02e0 THEN 0.5e0 ELSE 1e0 END AS exposure,
  CASE WHEN mom < -0.02e0 THEN 0.6e0 ELSE 1e0 END AS health,
  CASE WHEN mom < -0.02e0 THEN 8.5e0 ELSE 8e0 END AS min_score
FROM (SELECT c.dt, coalesce(r.regime, 'range') AS regime, coalesce(v.vix, 18e0) AS vix, coalesce(s.mom, 0e0) AS mom
  FROM (SELECT DISTINCT dt FROM macro) c ASOF LEFT JOIN regimes r ON c.dt >= r.dt
  ASOF LEFT JOIN vixes v ON c.dt >= v.dt ASOF LEFT JOIN (SELECT * FROM credit WHERE mom IS NOT NULL) s ON c.dt >= s.dt)"""
F["macro_ret"] = "SELECT series, dt, close, close / lag(close) OVER (PARTITION BY series ORDER BY dt) - 1 AS ret FROM macro"
F["wide"] = """
SELECT dt, max(close) FILTER (series = 'QQQ') AS qqq, max(ret) FILTER (series = 'SPY') AS spy,
  max(ret) FILTER (series = 'TLT') AS tlt, max(ret) FILTER (series = 'DXY') AS dxy FROM macro_ret GROUP BY dt"""

# --- cross-series and multi-period features ---------------------------------------------------
F["x0"] = """
SELECT i0.sym, i0.dt, i0.i, i0.close, coalesce(i0.close / i0.pc - 1, 0) AS r, w.qqq,
  coalesce(w.spy, 0) AS s, coalesce(w.tlt, 0) AS t, coalesce(w.dxy, 0) AS d
FROM i0 LEFT JOIN wide w ON i0.dt = w.dt"""
F["x1"] = f"""
SELECT sym, dt, i,
  CASE WHEN i >= 59 AND var_samp(s) OVER {rows(60)} > 0
    THEN covar_samp(r, s) OVER {rows(60)} / var_samp(s) OVER {rows(60)} ELSE 1 END AS beta_60d,
  CASE WHEN i >= 59 THEN stddev_samp(s) OVER {rows(20)} * sqrt(252e0) * 100 ELSE 15 END AS spy_vol,
  CASE WHEN i >= 89 THEN coalesce(covar_samp(r, t) OVER {rows(90)} / nullif(stddev_samp(r) OVER {rows(90)}
    * stddev_samp(t) OVER {rows(90)}, 0), 0) ELSE 0 END AS tlt_corr,
  CASE WHEN i >= 19 THEN coalesce(covar_samp(r, d) OVER {rows(20)} / nullif(stddev_samp(r) OVER {rows(20)}
    * stddev_samp(d) OVER {rows(20)}, 0), 0) ELSE 0 END AS dxy_corr
FROM x0"""
F["x2"] = """
SELECT *, close / lag(close) OVER w - 1 AS rs, qqq / lag(qqq) OVER w - 1 AS rq, row_number() OVER w AS m,
  close / lag(close, 19) OVER w AS c19, qqq / lag(qqq, 19) OVER w AS q19
FROM x0 WHERE qqq IS NOT NULL WINDOW w AS (PARTITION BY sym ORDER BY dt)"""
F["x3"] = f"""
SELECT sym, dt, CASE WHEN m >= 60 THEN c19 / greatest(q19, 0.5e0) END AS rs_20,
  CASE WHEN m >= 60 THEN (avg(rs) OVER {rows(5)} - CASE WHEN var_samp(rq) OVER {rows(60)} > 0
    THEN covar_samp(rs, rq) OVER {rows(60)} / (var_samp(rq) OVER {rows(60)} + 1e-10) ELSE 1 END
    * avg(rq) OVER {rows(5)}) * 252 END AS pure_alpha FROM x2"""
F["cross_feats"] = """
SELECT x1.*, coalesce(x3.rs_20, 0) AS rs_20, coalesce(x3.pure_alpha, 0) AS pure_alpha, (c.vix - x1.spy_vol) / greatest(c.vix, 1) AS vrp
FROM x1 ASOF LEFT JOIN (SELECT * FROM x3 WHERE rs_20 IS NOT NULL) x3 ON x1.sym = x3.sym AND x1.dt >= x3.dt
LEFT JOIN ctx c ON x1.dt = c.dt"""
F["wk0"] = "SELECT *, row_number() OVER (PARTITION BY sym ORDER BY dt) - 1 AS i FROM weeks"
F["wk1"] = f"""
SELECT *, {E('close', span(10))} AS e10, {E('close', span(30))} AS e30,
  {E('close', span(12))} - {E('close', span(26))} AS macd, {R('avg', 'close', 40)} AS m40 FROM wk0"""
F["wk2"] = f"SELECT *, macd - {E('macd', span(9))} AS hist FROM wk1"
F["week_flags"] = f"""
SELECT sym, dt, coalesce(i >= 39 AND close > m40 AND close > e10 AND e10 > e30, false) AS bull,
  coalesce(i >= 39 AND hist > 0 AND hist > {L('hist')}, false) AS macd_up FROM wk2"""
F["month_flags"] = """
SELECT sym, dt, count(*) OVER w = 3 AND min((close - open) / (high - low + 1e-10) * volume) OVER w > 0 AS flow
FROM months WINDOW w AS (PARTITION BY sym ORDER BY dt ROWS 2 PRECEDING)"""
F["period_feats"] = """
SELECT b.sym, b.dt, coalesce(w.bull, false) AS weekly_bullish, coalesce(w.macd_up, false) AS weekly_macd_res,
  coalesce(m.flow, false) AS monthly_inst_flow
FROM (SELECT sym, dt, CAST(date_trunc('week', dt) AS DATE) + 6 AS wk, last_day(dt) AS mo FROM bars) b
ASOF LEFT JOIN week_flags w ON b.sym = w.sym AND b.wk > w.dt
ASOF LEFT JOIN month_flags m ON b.sym = m.sym AND b.mo > m.dt"""
F["period_live"] = """
SELECT p.sym, p.dt, CASE WHEN p.dt = n.last THEN coalesce(w.bull, false) ELSE p.weekly_bullish END AS weekly_bullish,
  CASE WHEN p.dt = n.last THEN coalesce(w.macd_up, false) ELSE p.weekly_macd_res END AS weekly_macd_res,
  CASE WHEN p.dt = n.last THEN coalesce(m.flow, false) ELSE p.monthly_inst_flow END AS monthly_inst_flow
FROM period_feats p JOIN (SELECT sym, max(dt) AS last FROM bars GROUP BY sym) n ON p.sym = n.sym
LEFT JOIN week_flags w ON w.sym = p.sym AND w.dt = CAST(date_trunc('week', p.dt) AS DATE) + 6
LEFT JOIN month_flags m ON m.sym = p.sym AND m.dt = last_day(p.dt)"""
F["hr0"] = """
SELECT *, row_number() OVER w - 1 AS i, close - lag(close) OVER w AS d FROM hours WINDOW w AS (PARTITION BY sym ORDER BY dt)"""
F["hr1"] = f"""
SELECT sym, dt, i, 100 - 100 / (1 + ({E('CASE WHEN d > 0 THEN d ELSE 0 END', span(14))})
  / ({E('CASE WHEN d < 0 THEN -d ELSE 0 END', span(14))} + 1e-10)) AS rsi FROM hr0"""
F["hr_moved"] = f"""
SELECT sym, dt + to_days(CAST((SELECT max(dt) FROM bars) - (SELECT max(CAST(ts AS DATE)) FROM events) AS INT)) AS at_, rsi,
  coalesce(i >= 14 AND rsi > {L('rsi')} AND {L('rsi')} < 40, false) AS bounce FROM hr1"""
F["hour_feats"] = """
SELECT b.sym, b.dt, CASE WHEN h.at_ >= b.t - INTERVAL 3 DAY THEN h.rsi END AS rsi_60m,
  coalesce(h.at_ >= b.t - INTERVAL 3 DAY AND h.bounce, false) AS bounce
FROM (SELECT sym, dt, CAST(dt + 1 AS TIMESTAMP) AS t FROM bars) b ASOF LEFT JOIN hr_moved h ON b.sym = h.sym AND b.t > h.at_"""
F["gaps"] = """
SELECT sym, dt, i, high, low, CASE WHEN low > lag(high, 2) OVER w THEN lag(high, 2) OVER w END AS g_lo,
  CASE WHEN low > lag(high, 2) OVER w THEN low END AS g_up FROM i0 WINDOW w AS (PARTITION BY sym ORDER BY dt)"""
F["gap_feats"] = """
SELECT sym, dt, CASE WHEN i >= 21 THEN coalesce(last_value(g_lo IGNORE NULLS) OVER w, 0) ELSE 0 END AS fvg_lower,
  CASE WHEN i >= 21 THEN coalesce(last_value(g_up IGNORE NULLS) OVER w, 0) ELSE 0 END AS fvg_upper,
  CASE WHEN i >= 10 THEN max(high) OVER (PARTITION BY sym ORDER BY dt ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)
    ELSE high END AS swing_high_10
FROM gaps WINDOW w AS (PARTITION BY sym ORDER BY dt ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)"""

# --- statistics of every bar -------------------------------------------------------------------
F["arrays"] = """
SELECT sym, list(close ORDER BY dt) AS c, list(volume ORDER BY dt) AS v, list(lc ORDER BY dt) AS lc, list(sq ORDER BY dt) AS sq FROM (
  SELECT *, ln(greatest(close, 1e-10)) AS lc, sum(coalesce(pow(ln(greatest(close, 1e-10)) - ln(greatest(pc, 1e-10)), 2), 0))
    OVER (PARTITION BY sym ORDER BY dt ROWS UNBOUNDED PRECEDING) AS sq FROM i0) GROUP BY sym"""
F["waves"] = """
SELECT n, k, list_transform(range(0, n), lambda j: cos(2 * pi() * k * j / n)) AS co,
  list_transform(range(0, n), lambda j: -sin(2 * pi() * k * j / n)) AS si
FROM (SELECT unnest([105,110,115,120,125,130,135]) AS n), (SELECT unnest(range(1, 60)) AS k)
WHERE k * 1e0 / n > 0.01e0 AND k * 1e0 / n < 0.2e0"""
F["fft_vote"] = """
SELECT sym, dt, avg(CASE WHEN now > 0 AND now < pi() THEN 1e0 ELSE -1e0 END) AS score FROM (
  SELECT sym, dt, a - 2 * pi() * floor(a / (2 * pi())) AS now FROM (
    SELECT sym, dt, n, arg_max(2 * pi() * (k * 1e0 / n) * (n - 1) + atan2(im, re), re * re + im * im) AS a FROM (
      SELECT g.sym, g.dt, g.n, w.k, list_inner_product(g.x, w.co) AS re, list_inner_product(g.x, w.si) AS im FROM (
        SELECT i0.sym, i0.dt, n, list_transform(a.c[i - n + 2:i + 1], lambda y: y - close) AS x
        FROM i0 JOIN arrays a ON i0.sym = a.sym, (SELECT DISTINCT n FROM waves) WHERE i >= 134) g JOIN waves w ON g.n = w.n
      WHERE list_min(g.x) < list_max(g.x))
    GROUP BY sym, dt, n)) GROUP BY sym, dt"""
F["hurst_exp"] = """
SELECT sym, dt, ln((list_max(path) - list_min(path)) / sd) / ln(size) AS h FROM (
  SELECT sym, dt, size, sqrt(greatest(ss / size - m * m, 0)) AS sd,
    list_transform(l[2:], lambda y, k: y - l[1] - k * m) AS path FROM (
      SELECT *, (l[size + 1] - l[1]) / size AS m FROM (
        SELECT i0.sym, i0.dt, size, a.lc[beg + 1:beg + size + 1] AS l, a.sq[beg + size + 1] - a.sq[beg + 1] AS ss FROM (
          SELECT i AS bar, n, size, i - n + (j * 101) % (n - size) AS beg FROM (
            SELECT i, least(i, 120) AS n, j, 30 + (j * 37) % (least(i, 120) - 30) AS size
            FROM (SELECT DISTINCT i FROM i0 WHERE i > 30), (SELECT unnest(range(0, 100)) AS j))) p
        JOIN i0 ON i0.i = p.bar JOIN arrays a ON i0.sym = a.sym)))
WHERE sd > 1e-12 AND list_max(path) - list_min(path) > 1e-12"""
F["hurst_stat"] = """
SELECT sym, dt, med, iqr, iqr < 0.15e0 AND abs(med - 0.5e0) > 0.1e0 AS sure FROM (
  SELECT sym, dt, median(h) AS med, quantile_cont(h, 0.75) - quantile_cont(h, 0.25) AS iqr FROM hurst_exp
  GROUP BY sym, dt HAVING count(*) >= 20)"""
F["kde_in"] = """
SELECT sym, dt, close, p, list_transform(v, lambda y: y / total) AS w FROM (
  SELECT i0.sym, i0.dt, close, a.c[i - 58:i + 1] AS p, a.v[i - 58:i + 1] AS v, list_sum(a.v[i - 58:i + 1]) AS total
  FROM i0 JOIN arrays a ON i0.sym = a.sym WHERE i >= 59) WHERE list_stddev_pop(p) > 1e-5"""
F["kde_bw"] = """
SELECT *, pow(0.75e0 / w2, -0.4e0) * list_sum(list_transform(list_zip(p, w), lambda z: z[2] * (z[1] - m) * (z[1] - m))) / (1 - w2) AS h2
FROM (SELECT *, list_inner_product(w, w) AS w2, list_inner_product(w, p) AS m FROM kde_in)"""
F["kde_den"] = """
SELECT sym, dt, g, list_sum(list_transform(list_zip(p, w), lambda z: z[2] * exp(-(pt - z[1]) * (pt - z[1]) / (2 * h2)))) / sqrt(2 * pi() * h2) AS den
FROM (SELECT *, CASE WHEN g = 200 THEN close ELSE list_min(p) + (list_max(p) - list_min(p)) * g / 199e0 END AS pt
      FROM kde_bw, (SELECT unnest(range(0, 201)) AS g))"""
F["kde_stat"] = """
SELECT sym, dt, CASE WHEN cur <= d50 THEN least(1, 0.5e0 + 0.5e0 * (d50 - cur) / (d50 + 1e-10)) ELSE 0 END AS score FROM (
  SELECT sym, dt, median(den) FILTER (g < 200) AS d50, max(den) FILTER (g = 200) AS cur FROM kde_den GROUP BY sym, dt)"""
F["stat_feats"] = """
SELECT b.sym, b.dt, coalesce(f.score, 0) AS fft_score, coalesce(k.score, 0) AS kde_score, coalesce(h.med, 0.5e0) AS hurst_med,
  coalesce(h.iqr, 0) AS hurst_iqr, coalesce(h.sure, false) AS hurst_sure
FROM bars b LEFT JOIN fft_vote f ON b.sym = f.sym AND b.dt = f.dt LEFT JOIN kde_stat k ON b.sym = k.sym AND b.dt = k.dt
LEFT JOIN hurst_stat h ON b.sym = h.sym AND b.dt = h.dt"""


# --- sequences ---------------------------------------------------------------------------------
def _rel(x: str) -> str:
    return f"{x} / (close + 1e-10) - 1"


def _over(n: str, d: str) -> str:
    return f"({n}) / nullif({d} + 1e-10, 0)"


def _chg(x: str) -> str:
    return (f"CASE WHEN {L(x)} = 0 THEN CASE WHEN {x} = 0 THEN NULL ELSE 'Infinity'::DOUBLE END ELSE {x} / {L(x)} - 1 END")


SEQ = [
    "RSI / 100", *[f"{x} / (close + 1e-10)" for x in ("MACD", "Signal_Line", "ATR", "(KC_Upper - KC_Lower)", "(BB_Upper - BB_Lower)")],
    *[_rel(x) for x in ("Tenkan", "Kijun", "SenkouA", "SenkouB")], "SuperTrend_Up::INT", "CMF", "Range / (close + 1e-10)",
    "NR7::INT", "Inside_Bar::INT", "VPT_ZScore", "VPT_Accel", _rel("VWAP_20"), _rel("VWAP_20"), _over("volume", "Max_Down_Vol_10"),
    *[_rel(x) for x in ("OB_High", "OB_Low", "Swing_Low_20")], "Range_60 / (close + 1e-10)", "Range_20 / (close + 1e-10)",
    _rel("Price_High_20"), _over("volume", "Vol_MA20"), "CVD_Trend", "CVD_Divergence", _rel("Highest_22"), "ATR_22 / (close + 1e-10)",
    _rel("Chandelier_Exit"), "Smart_Money_Flow", "Recent_Price_Surge_3d / 100", "Recent_Vol_Surge_3d", "Amihud", "Dist_52W_High",
    *[f"{_over('close', x)} - 1" for x in ("SMA_50", "SMA_150", "SMA_200", "EMA_20", "EMA_50")], "Above_Cloud::INT",
    *[_rel(x) for x in ("open", "high", "low")], _chg("close"), _chg("volume"), _over("close - open", "(high - low)"),
]
_seq = ", ".join(
    f"CAST(CASE WHEN v{k} IS NULL OR isnan(v{k}) THEN 0 WHEN isinf(v{k}) THEN sign(v{k}) * 5 ELSE v{k} END AS FLOAT)::DOUBLE AS v{k}"
    for k in range(len(SEQ)))
_raw = ", ".join(f"CAST({x} AS DOUBLE) AS v{k}" for k, x in enumerate(SEQ))
F["seq_raw"] = f"SELECT sym, dt, i, {_raw} FROM ind"
F["seq_rows"] = f"SELECT sym, dt, i, {_seq} FROM seq_raw"
_vec = ", ".join(f"CASE WHEN i >= 59 THEN avg(v{k}) OVER w ELSE 0 END" for k in range(16))
F["vecs"] = f"SELECT sym, dt, i, [{_vec}] AS vec FROM seq_rows WINDOW w AS (PARTITION BY sym ORDER BY dt ROWS 59 PRECEDING)"
_all = " + ".join(f"greatest(-50, least(50, v{k}))" for k in range(len(SEQ)))


def seq_sums(bars: str) -> str:
    """Sums of the sequences of a table that is made like ``seq_rows``, each value held within +/-50."""
    return f"""
SELECT sym, dt, i, CASE WHEN i >= 59 THEN lag(s - moved, 59) OVER w ELSE 0 END AS first_sum, CASE WHEN i >= 59 THEN s ELSE 0 END AS last_sum,
  CASE WHEN i >= 59 THEN sum(s) OVER (w ROWS 59 PRECEDING) - lag(moved, 59) OVER w ELSE 0 END AS all_sum
FROM (SELECT *, {_all} AS s, greatest(-50, least(50, v46)) + greatest(-50, least(50, v47)) AS moved FROM {bars})
WINDOW w AS (PARTITION BY sym ORDER BY dt)"""


F["seq_sums"] = seq_sums("seq_rows")
for _f in ("i0", "i1", "cvd", "i2", "i3", "i4", "ind", "seq_raw", "seq_rows"):
    # the same chain over the wilder bars
    F[f"w_{_f}"] = re.sub(r"\b(i0|i1|i2|i3|i4|ind|seq_raw|cvd)\b(?=\s+(JOIN|ON|a\b|b\b|WINDOW)|\.|\s*$)", r"w_\1", F[_f]).replace("FROM bars", "FROM bars_wild")


def compose(statement: str) -> str:
    """WITH every fragment the statement needs, dependencies first."""
    done: list[str] = []

    def visit(text: str) -> None:
        for name in F:
            if name not in done and re.search(rf"\b(FROM|JOIN|,)\s*\(?\s*{name}\b", text):
                visit(F[name])
                if name not in done:
                    done.append(name)

    visit(statement)
    if not done:
        return statement
    parts = [f"{n} AS MATERIALIZED ({F[n].strip()})" for n in done]
    return "WITH " + ",\n".join(parts) + "\n" + statement


KIND = {"i": "CAST({0} AS BIGINT) AS {1}", "d": "CAST({0} AS VARCHAR) AS {1}",
        "t": "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {1}", "b": "CAST({0} AS BIGINT) AS {1}",
        "f": "round(CAST({0} AS DOUBLE), 4) + 0e0 AS {1}", "s": "{0} AS {1}"}


def q(source: str, columns: str, where: str = "") -> str:
    """SELECT of typed columns ('name:kind' or 'expr=name:kind') from a fragment or sub-query."""
    items = []
    for c in columns.split():
        name, kind = c.rsplit(":", 1)
        expr, _, alias = name.partition("=")
        items.append(KIND[kind].format(expr, alias or expr))
    src = source if re.fullmatch(r"\w+", source) else f"({source})"
    return compose(f"SELECT {', '.join(items)} FROM {src} {where}".strip())
