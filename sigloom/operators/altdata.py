"""Alternative data per symbol: options, short interest, insiders, analysts, mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigloom.functions.scan import exact_quantiles
from sigloom.session import broadcast_if_small, materialise

# Score of an analyst action; anything else is 0.
ACTION_SCORES = {"up": 1.0, "down": -1.0, "main": 0.0, "init": 0.5, "reit": 0.0}


def first_expiry(chain: DataFrame) -> DataFrame:
    """Options of each symbol's first expiry (an aggregate joined back, not a window)."""
    first = chain.groupBy("sym").agg(F.min("expiry").alias("expiry"))
    return chain.join(broadcast_if_small(first), ["sym", "expiry"])


def put_call_ratio(chain: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """sym, pcr on the first expiry; 1 without call volume. ``first``: the chain's ``first_expiry``, where a caller has it."""
    put = F.sum(F.when(F.col("type") == "put", F.col("volume")).otherwise(0.0))
    call = F.sum(F.when(F.col("type") == "call", F.col("volume")).otherwise(0.0))
    return (first or first_expiry(chain)).groupBy("sym").agg(put.alias("p"), call.alias("c")).select(
        "sym", F.when(F.col("c") > 0, F.col("p") / F.col("c")).otherwise(1.0).alias("pcr"))


def market_put_call(chain: DataFrame) -> DataFrame:
    """expiry, market_pcr: put over call volume of all symbols; 1 without call volume."""
    put = F.sum(F.when(F.col("type") == "put", F.col("volume")).otherwise(0.0))
    call = F.sum(F.when(F.col("type") == "call", F.col("volume")).otherwise(0.0))
    return chain.groupBy("expiry").agg(put.alias("p"), call.alias("c")).select(
        "expiry", F.when(F.col("c") > 0, F.col("p") / F.col("c")).otherwise(1.0).alias("market_pcr"))


def iv_skew(chain: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """sym, iv_skew: median put minus median call volatility of the first expiry; 0 if either
    side is missing. The medians are exact for groups of any size."""
    med = exact_quantiles(first or first_expiry(chain), ["sym", "type"], "iv", {"med": 0.5})
    put = F.max(F.when(F.col("type") == "put", F.col("med")))
    call = F.max(F.when(F.col("type") == "call", F.col("med")))
    return med.groupBy("sym").agg(F.coalesce(put - call, F.lit(0.0)).alias("iv_skew"))


def short_change(interest: DataFrame) -> DataFrame:
    """sym, short_change (last month against the month row before), short_float. Two rows per
    symbol are kept by a limited rank, so history length does not matter."""
    w = Window.partitionBy("sym").orderBy(F.desc("month"))
    two = interest.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    cur = F.max(F.when(F.col("rn") == 1, F.col("shares_short")))
    prev = F.max(F.when(F.col("rn") == 2, F.col("shares_short")))
    flt = F.max(F.when(F.col("rn") == 1, F.col("float_share")))
    s = two.groupBy("sym").agg(cur.alias("cur"), prev.alias("prev"), flt.alias("short_float"))
    return s.select(
        "sym", F.when((F.col("cur") != 0) & (F.col("prev") > 0), (F.col("cur") - F.col("prev")) / F.col("prev")
                      ).otherwise(0.0).alias("short_change"),
        F.coalesce("short_float", F.lit(0.0)).alias("short_float"))


def insider_net(tx: DataFrame, last: int = 20) -> DataFrame:
    """sym, insider: (buys - sells)/(buys + sells) over the newest ``last`` rows of each symbol.
    The rank limit is applied inside every map task before rows are exchanged."""
    w = Window.partitionBy("sym").orderBy(F.desc("dt"), F.desc("tx_id"))
    top = tx.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= last)
    buys = F.sum(F.when(F.col("shares") > 0, F.col("shares")).otherwise(0.0))
    sells = F.sum(F.when(F.col("shares") < 0, -F.col("shares")).otherwise(0.0))
    return top.groupBy("sym").agg(buys.alias("b"), sells.alias("s")).select(
        "sym", F.when(F.col("b") + F.col("s") > 0, (F.col("b") - F.col("s")) / (F.col("b") + F.col("s"))
                      ).otherwise(0.0).alias("insider"))


def analyst_momentum(actions: DataFrame, days: int = 365, bucket: int = 30) -> DataFrame:
    """sym, analyst: last 30-day bucket against mean and sample deviation of the earlier ones.

    Buckets start at the symbol's first action of the year; empty ones count as 0. They are not
    generated: their share of the deviation is (number missing) x mean^2.
    """
    scores = F.create_map(*[x for k, v in ACTION_SCORES.items() for x in (F.lit(k), F.lit(v))])
    daily = actions.groupBy("sym", "dt").agg(
        F.sum(F.coalesce(F.try_element_at(scores, F.col("action")), F.lit(0.0))).alias("s"))
    end = daily.agg(F.max("dt").alias("_end"))  # one row
    recent = daily.crossJoin(F.broadcast(end)).where(F.col("dt") >= F.date_sub("_end", days))
    start = recent.groupBy("sym").agg(F.min("dt").alias("_d0"), F.sum("s").alias("_all"))
    b = F.floor(F.datediff("dt", "_d0") / bucket).cast("long")
    buckets = recent.join(broadcast_if_small(start), "sym").groupBy("sym", "_all", b.alias("b")).agg(
        F.sum("s").alias("s"))
    # at most 13 buckets per symbol
    last = Window.partitionBy("sym")
    buckets = buckets.withColumn("_last", F.max("b").over(last))
    early = F.col("b") < F.col("_last")
    buckets = buckets.withColumn("mean", F.sum(F.when(early, F.col("s")).otherwise(0.0)).over(last)
                                 / F.greatest(F.col("_last"), F.lit(1)))
    dev = (F.col("s") - F.col("mean")) * (F.col("s") - F.col("mean"))
    agg = buckets.groupBy("sym", "_all", "_last", "mean").agg(
        F.max(F.when(~early, F.col("s"))).alias("newest"),
        F.sum(F.when(early, dev).otherwise(0.0)).alias("ss"),
        F.sum(early.cast("long")).alias("present"))
    var = (F.col("ss") + (F.col("_last") - F.col("present")) * F.col("mean") * F.col("mean")) / (
        F.greatest(F.col("_last") - 1, F.lit(1)))
    return agg.select("sym", F.when(
        F.col("_last") >= 2, (F.col("newest") - F.col("mean")) / (F.sqrt(var) + 1e-5)
    ).otherwise(F.col("_all") * 0.1).alias("analyst"))


def bullish_counts(mentions: DataFrame) -> DataFrame:
    """day, ticker, comments of bullish mentions."""
    return mentions.where("sentiment = 'Bullish'").groupBy("day", "ticker").agg(
        F.max("comments").alias("comments"))


def last_days(mentions: DataFrame, n: int = 5) -> DataFrame:
    """Rows of the newest ``n`` dates of the whole table; the dates are ranked, not the rows."""
    days = mentions.select("day").distinct().orderBy(F.desc("day")).limit(n)
    days = days.withColumn("k", F.row_number().over(Window.orderBy(F.desc("day"))) - 1)
    return mentions.join(F.broadcast(days), "day")  # n rows


def mention_acceleration(mentions: DataFrame) -> DataFrame:
    """ticker, mention_accel = (v0-v1) - (v1-v2) over the three newest dates of the table, for
    tickers seen on the newest; 0 when the table has fewer than three dates."""
    recent = last_days(bullish_counts(mentions), 3)

    def v(k: int):
        return F.sum(F.when(F.col("k") == k, F.col("comments")).otherwise(0))

    dates = recent.agg(F.max("k").alias("_k"))  # one row
    per = recent.groupBy("ticker").agg(
        v(0).alias("v0"), v(1).alias("v1"), v(2).alias("v2"), F.min("k").alias("newest"))
    accel = F.col("v0") - F.col("v1") - (F.col("v1") - F.col("v2"))
    return per.where("newest = 0").crossJoin(F.broadcast(dates)).select(
        "ticker", F.when(F.col("_k") >= 2, accel).otherwise(0).cast("double").alias("mention_accel"))


def alt_snapshot(chain: DataFrame, interest: DataFrame, tx: DataFrame, actions: DataFrame,
                 mentions: DataFrame) -> DataFrame:
    """One row per symbol with every alternative input; absent ones stay null."""
    first = materialise(first_expiry(chain))  # a symbol's first month
    out = put_call_ratio(chain, first).join(iv_skew(chain, first), "sym", "full_outer")
    for part in (short_change(interest), insider_net(tx), analyst_momentum(actions),
                 mention_acceleration(mentions).withColumnRenamed("ticker", "sym")):
        out = out.join(part, "sym", "full_outer")
    return out
