"""Bar tables: ticks to bars, calendar resampling, de-duplication, period cuts, universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ohlcv(by: str) -> list[Column]:
    return [
        F.min_by("open", by).alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", by).alias("close"),
        F.sum("volume").alias("volume"),
    ]


def weekly_bars(bars: DataFrame) -> DataFrame:
    """Weeks end on Sunday and are labelled by it; weeks without a bar do not appear."""
    week = F.date_add(F.to_date(F.date_trunc("week", "dt")), 6)
    return bars.groupBy("sym", week.alias("wk")).agg(*_ohlcv("dt")).withColumnRenamed("wk", "dt")


def monthly_bars(bars: DataFrame) -> DataFrame:
    """Labelled by the last calendar day of the month."""
    return bars.groupBy("sym", F.last_day("dt").alias("mo")).agg(*_ohlcv("dt")).withColumnRenamed(
        "mo", "dt")


def hourly_bars(ticks: DataFrame) -> DataFrame:
    """Tumbling one-hour OHLCV; ``seq`` orders ticks that share a timestamp."""
    at = F.struct("ts", "seq")
    return ticks.groupBy("sym", F.date_trunc("hour", "ts").alias("dt")).agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", at).alias("close"), F.sum("q").alias("volume"))


def dedupe_last(bars: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Keep the row with the highest ``seq`` per key.

    An aggregation, not a row number: copies collapse map-side, however many a key has.
    """
    rest = [c for c in bars.columns if c not in keys]
    best = bars.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_r"))
    return best.select(*keys, "_r.*")


# Day counts of the named periods.
PERIOD_DAYS = {"1mo": 30, "3mo": 90, "6mo": 183, "1y": 365, "2y": 730, "5y": 1825}


def period_cut(bars: DataFrame, period: str, as_of: Column | None = None) -> DataFrame:
    """Rows of the last ``period`` before ``as_of`` (default: the table's last date).

    '5d' means the last five bars of each symbol.
    """
    if period == "5d":
        newest = Window.partitionBy("sym").orderBy(F.desc("dt"))
        return bars.withColumn("_rn", F.row_number().over(newest)).where("_rn <= 5").drop("_rn")
    days = PERIOD_DAYS[period]
    if as_of is not None:
        return bars.where(F.col("dt") >= F.date_sub(as_of, days))
    # one row: the last date
    end = bars.agg(F.max("dt").alias("_end"))
    return bars.crossJoin(F.broadcast(end)).where(
        F.col("dt") >= F.date_sub("_end", days)).drop("_end")


def latest_bar(df: DataFrame) -> DataFrame:
    """Each symbol's last row, by aggregation."""
    return dedupe_last(df, ["sym"], "dt")


def with_min_bars(df: DataFrame, n: int) -> DataFrame:
    """Rows of symbols that have at least ``n`` bars."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy("sym"))).where(
        F.col("_n") >= n).drop("_n")


def universe(core: DataFrame, index: DataFrame, n: int, seed: str = "u") -> DataFrame:
    """Core list and index members ('.' written as '-'), distinct, n of them in hash order."""
    sym = F.translate(F.col("sym").cast("string"), ".", "-").alias("sym")
    pool = core.select(sym).union(index.select(sym)).distinct()
    return pool.orderBy(F.md5(F.concat(F.lit(seed), F.col("sym"))), "sym").limit(n)


def calendar(bars: DataFrame) -> DataFrame:
    """Union of all symbols' dates with a 0-based index; one row per date."""
    dates = bars.select("dt").distinct()
    return dates.select("dt", (F.row_number().over(Window.orderBy("dt")).cast("long") - 1).alias("idx"))
