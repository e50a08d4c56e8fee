"""Market context: one row per calendar date from a handful of macro series.

Every table here has at most one row per date (or per series and date), so windows without a
partition column and broadcasts of the result are bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigloom.functions.scalar import yes

RETURN_SERIES = ("SPY", "TLT", "DXY")


def _one(macro: DataFrame, name: str) -> DataFrame:
    return macro.where(F.col("series") == name).select("dt", "close")


def macro_wide(macro: DataFrame) -> DataFrame:
    """dt, qqq_close, spy_ret, tlt_ret, dxy_ret: each return is taken on its own calendar,
    before any alignment."""
    w = Window.partitionBy("series").orderBy("dt")
    prev = F.lag("close").over(w)
    r = macro.withColumn("ret", F.when(prev != 0, F.col("close") / prev - 1))
    pick = [F.max(F.when(F.col("series") == "QQQ", F.col("close"))).alias("qqq_close")] + [
        F.max(F.when(F.col("series") == s, F.col("ret"))).alias(f"{s.lower()}_ret")
        for s in RETURN_SERIES
    ]
    return r.groupBy("dt").agg(*pick)


def regime_label(close: Column, sma50: Column, sma200: Column, trend: Column, rows: Column) -> Column:
    """Five labels; too short a history is 'range'. Weak momentum or a lost 50-day average
    leaves the upper branch before the 200-day average is tested."""
    weak = yes(trend < -0.04) | yes(close < sma50)
    above = yes(close > sma200)
    return (
        F.when(rows < 200, "range")
        .when(weak & above, "hidden_bear")
        .when(weak & yes(trend < -0.02), "bear")
        .when(weak, "rebound")
        .when(above & yes(trend > 0.02), "bull")
        .otherwise("range")
    )


def market_regime(macro: DataFrame, index: str = "QQQ") -> DataFrame:
    """dt, close, sma50, sma200, trend20, regime on the index series' own dates."""
    w = Window.orderBy("dt")
    n = F.row_number().over(w)

    def mean(k: int) -> Column:
        return F.when(n >= k, F.avg("close").over(w.rowsBetween(-(k - 1), 0)))

    q = _one(macro, index).withColumns({
        "rows": n, "sma50": mean(50), "sma200": mean(200),
        "trend20": F.try_divide(F.col("close"), F.lag("close", 19).over(w)) - 1,
    })
    return q.withColumn("regime", regime_label(
        F.col("close"), F.col("sma50"), F.col("sma200"), F.col("trend20"), F.col("rows"))
    ).drop("rows")


def vix_band(vix: Column) -> Column:
    return (F.when(vix > 30, "extreme_fear").when(vix > 25, "fear").when(vix < 15, "calm")
            .otherwise("normal"))


def vix_level(macro: DataFrame) -> DataFrame:
    """dt, vix, band; a missing close is 18."""
    v = _one(macro, "VIX").select("dt", F.coalesce("close", F.lit(18.0)).alias("vix"))
    return v.withColumn("vix_band", vix_band(F.col("vix")))


def vix_term(macro: DataFrame, days: int = 63) -> DataFrame:
    """dt, term: the volatility index over its mean of ``days`` rows, for want of a three-month index; 1 before."""
    w = Window.orderBy("dt").rowsBetween(1 - days, 0)  # one series: a row for each date
    v = macro.where("series = 'VIX'")
    return v.select("dt", F.when(F.count("close").over(w) >= days, F.try_divide("close", F.avg("close").over(w))).otherwise(1.0).alias("term"))


def credit_spread(macro: DataFrame) -> DataFrame:
    """dt, ratio, credit_spread_mom (20-row change of HYG/IEI, padded over gaps), risk flag."""
    hyg = _one(macro, "HYG").withColumnRenamed("close", "hyg")
    iei = _one(macro, "IEI").withColumnRenamed("close", "iei")
    w = Window.orderBy("dt")
    r = hyg.join(iei, "dt", "full_outer").withColumn("ratio", F.try_divide("hyg", "iei"))
    r = r.withColumn("ratio", F.last("ratio", ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("credit_spread_mom", F.try_divide(F.col("ratio"), F.lag("ratio", 20).over(w)) - 1)
    return r.select("dt", "ratio", "credit_spread_mom",
                    yes(F.col("credit_spread_mom") < -0.02).alias("is_credit_risk_high"))


def market_context(macro: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """One row per date of ``dates`` (default: the macro dates): the last known state of each
    input, the exposure, health and minimum score that follow from it."""
    cal = (dates if dates is not None else macro).select("dt").distinct()
    w = Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    states = (
        cal.withColumn("wanted", F.lit(True))
        .join(market_regime(macro).select("dt", "regime"), "dt", "full_outer")
        .join(vix_level(macro).select("dt", "vix"), "dt", "full_outer")
        .join(credit_spread(macro).select("dt", "credit_spread_mom"), "dt", "full_outer")
    )
    known = states.select(
        "dt", "wanted",
        F.coalesce(F.last("regime", ignorenulls=True).over(w), F.lit("range")).alias("regime"),
        F.coalesce(F.last("vix", ignorenulls=True).over(w), F.lit(18.0)).alias("vix"),
        F.coalesce(F.last("credit_spread_mom", ignorenulls=True).over(w), F.lit(0.0)).alias(
            "credit_spread_mom"),
    ).where("wanted").drop("wanted")
    risk = F.col("credit_spread_mom") < -0.02
    base = (F.when(F.col("regime") == "bear", 0.3).when(F.col("regime") == "hidden_bear", 0.5)
            .when(F.col("regime") == "rebound", 0.6).otherwise(1.0))
    return known.select(
        "*", vix_band(F.col("vix")).alias("vix_band"), risk.alias("is_credit_risk_high"),
        risk.alias("macro_gravity"),
        (base * F.when(risk, 0.5).otherwise(1.0)).alias("exposure"),
        F.when(risk, 0.6).otherwise(1.0).alias("health"),
        F.when(risk, 8.5).otherwise(8.0).alias("dynamic_min_score"),
        F.lit(1.0).alias("w_mul"), F.lit(1.0).alias("vix_scalar"),
    )
