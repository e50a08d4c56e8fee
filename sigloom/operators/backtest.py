"""Historical picks against the bars: T+1 / T+3 / T+5 returns with costs, excursions, statistics.

Positions are rows of the *union* calendar. A symbol without a bar on a needed date has no price
there (null, row dropped), so offsets are equality joins on (sym, idx), never a ``lead``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigloom.functions.asof import asof_join
from sigloom.functions.scalar import EPS
from sigloom.functions.scan import exact_quantiles, prefix_sum
from sigloom.operators.bars import calendar
from sigloom.operators.factors import list_to_map
from sigloom.operators.tensors import sequence_tensor
from sigloom.params import ATTRIBUTION_FACTORS, BASELINE_FACTOR, Params
from sigloom.session import broadcast_if_small, materialise

HORIZONS = (1, 3, 5)


def flatten_picks(log: DataFrame) -> DataFrame:
    """Pick log to one row per pick: top picks and shadow pool together, macro defaults filled.

    Needs ``log_id`` (an order over the lines). ``ml_features`` is a map, or ``ml_list`` the
    positional form.
    """
    picks = F.concat(F.coalesce("top_picks", F.array()), F.coalesce("shadow_pool", F.array()))
    one = log.select("log_id", F.to_date("date").alias("dt"), "vix", "macro_meta",
                     F.posexplode(picks).alias("pos", "p"))
    m = F.col("macro_meta")
    feats = F.coalesce(F.col("p.ml_features"), F.when(
        F.col("p.ml_list").isNotNull(), list_to_map(F.col("p.ml_list"))))
    return one.select(
        "log_id", "pos", "dt", F.col("p.symbol").alias("sym"),
        F.coalesce(m["vix"], F.col("vix"), F.lit(18.0)).alias("vix"),
        F.coalesce(m["credit_spread_mom"], F.lit(0.0)).alias("cred"),
        F.coalesce(m["vix_term_structure"], F.lit(1.0)).alias("term"),
        F.coalesce(m["market_pcr"], F.lit(1.0)).alias("pcr"),
        F.coalesce(F.col("p.ai_prob"), F.lit(0.0)).alias("ai_prob"),
        F.coalesce(F.col("p.signals"), F.array()).alias("signals"),
        F.coalesce(F.col("p.factors"), F.array()).alias("factors"), feats.alias("ml_features"))


def factor_tags(df: DataFrame) -> DataFrame:
    """``factors``, or, where empty, the first word of the bracketed tag in each signal text."""
    tags = F.filter(F.transform("signals", lambda s: F.split(F.regexp_extract(s, r"\[(.*?)\]", 1), " ")[0]),
                    lambda t: t != "")
    return df.withColumn("factors", F.when(F.size("factors") > 0, F.col("factors")).otherwise(tags))


def signal_index(signals: DataFrame, cal: DataFrame) -> DataFrame:
    """Add ``idx``: first calendar date on or after the signal date; later signals drop out.

    The as-of runs over distinct dates only (bounded by the calendar), then joins by equality.
    """
    days = signals.select("dt").distinct().withColumn("idx", F.lit(None).cast("long"))
    both = cal.select("dt", "idx").unionByName(days).groupBy("dt").agg(F.max("idx").alias("idx"))
    nxt = both.withColumn("idx", F.first("idx", ignorenulls=True).over(
        Window.orderBy("dt").rowsBetween(0, Window.unboundedFollowing)))
    return signals.join(broadcast_if_small(nxt.where("idx IS NOT NULL")), "dt")


def _outcomes(bars: DataFrame, cal: DataFrame, asked: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """sym, idx, entry, prev_close and per horizon d: close x{d}, highest h{d} and lowest l{d} of the asked bars.

    A day beyond the calendar is its last one for prices, and none for the extremes. Days without a bar have no price.
    Bound: a row for each bar and asked date of one symbol, so the calendar's length.
    """
    n = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bars.select("sym", "idx", "open", "high", "low", "close", F.lit(True).alias("bar")).unionByName(
        asked.select("sym", "idx", F.lit(True).alias("asked")), allowMissingColumns=True)
    days = rows.repartition(n, "sym").groupBy("sym", "idx").agg(
        F.max("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("close").alias("close"),
        F.max("bar").alias("bar"), F.max("asked").alias("asked")).where("bar")
    return _outcome_columns(days, cal, F.col("asked"), {}, horizons, "idx")


def _at(k: int, c: str) -> Column:
    """``c`` on the ``k``-th calendar day after the row's own, or on the calendar's last; null without a bar on it."""
    place = F.least(F.col("idx") + k, F.col("last_idx"))
    return F.coalesce(*[F.when(F.col(f"d{j}.idx") == place, F.col(f"d{j}.{c}")) for j in range(k + 1)])


def with_return(days: DataFrame, cal: DataFrame, p: Params = Params(), horizon: int = 3, order: str = "dt") -> DataFrame:
    """``days`` (bars with ``idx`` of ``cal``) with the ``ret`` that ``trade_returns`` has for a signal on them, else null.

    For steps that need the other bars of the symbol too; bars that are dealt by ``sym`` are not exchanged again.
    """
    w, day = Window.partitionBy("sym").orderBy(order), F.struct("idx", "open", "close")
    df = days.withColumns({f"d{k}": F.lead(day, k).over(w) if k else day for k in range(horizon + 1)})
    df = df.crossJoin(F.broadcast(cal.agg(F.max("idx").alias("last_idx"))))  # one row
    df = df.withColumns({"entry": _at(1, "open"), "prev_close": F.col("close"), f"x{horizon}": _at(horizon, "close")})
    paid = (F.col("entry") > 0) & F.col("prev_close").isNotNull()
    return df.withColumns(_costs(p)).select(*days.columns, F.when(paid, _return(p, horizon)).alias("ret"))


def _outcome_columns(days: DataFrame, cal: DataFrame, asked: Column, columns: dict[str, Column], horizons: tuple[int, ...],
                     order: str) -> DataFrame:
    w, deep = Window.partitionBy("sym").orderBy(order), max(horizons)
    day = F.struct("idx", "open", "high", "low", "close")
    days = days.withColumns({f"d{k}": F.lead(day, k).over(w) if k else day for k in range(deep + 1)}).where(asked)
    days, at = days.crossJoin(F.broadcast(cal.agg(F.max("idx").alias("last_idx")))), _at  # one row
    cols = [at(1, "open").alias("entry"), F.col("close").alias("prev_close")]
    for d in horizons:
        inside = {c: [F.when(F.col(f"d{j}.idx") <= F.col("idx") + d, F.col(f"d{j}.{c}")) for j in range(1, d + 1)] for c in ("high", "low")}
        cols += [at(d, "close").alias(f"x{d}"), (F.greatest(*inside["high"]) if d > 1 else inside["high"][0]).alias(f"h{d}"),
                 (F.least(*inside["low"]) if d > 1 else inside["low"][0]).alias(f"l{d}")]
    return days.select("sym", "idx", *[c.alias(k) for k, c in columns.items()], *cols).where((F.col("entry") > 0) & F.col("prev_close").isNotNull())


def trade_returns(signals: DataFrame, bars: DataFrame, p: Params = Params(), carry: tuple[str, ...] = (),
                  horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """sig_id, sym, dt, idx, horizon, ret, mfe, mae (+ ``carry``), one row per surviving horizon.

    ``signals`` has a unique ``sig_id``. What follows a bar depends on its (sym, idx) alone, so it is worked out once on
    the bars, in one exchange on ``sym``, for those that a signal asks for, and brought to the signals by equality.
    """
    cal = broadcast_if_small(calendar(bars))
    sig = signal_index(signals.select("sig_id", "sym", "dt", *carry), cal)
    t = sig.join(_outcomes(bars.join(cal, "dt"), cal, sig.select("sym", "idx").distinct(), horizons), ["sym", "idx"])
    return _horizon_rows(t, p, carry, horizons)


def picked_returns(days: DataFrame, cal: DataFrame, picked: Column, columns: dict[str, Column], p: Params = Params(),
                   horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """``trade_returns`` of picks that are bars themselves: where ``picked`` holds on ``days`` (bars with ``idx`` of ``cal``).

    ``columns`` makes sig_id and what to carry from a picked bar. Nothing is brought together: bars that are dealt by
    ``sym`` already are not exchanged again.
    """
    t = _outcome_columns(days, cal, picked, {"dt": F.col("dt"), **columns}, horizons, "dt")
    return _horizon_rows(t, p, tuple(c for c in columns if c != "sig_id"), horizons)


def _costs(p: Params) -> dict[str, Column]:
    gap = (F.col("entry") - F.col("prev_close")) / (F.col("prev_close") + EPS)
    wide = gap > p.gap_limit
    return {"half": F.when(wide, 0.5).otherwise(1.0),
            "cost": F.col("entry") * (1 + F.when(wide, p.slippage * 3).otherwise(p.slippage) + p.commission)}


def _return(p: Params, d: int) -> Column:
    return (F.col(f"x{d}") * (1 - p.slippage - p.commission) - F.col("cost")) / (F.col("cost") + EPS) * F.col("half")


def _horizon_rows(t: DataFrame, p: Params, carry: tuple[str, ...], horizons: tuple[int, ...]) -> DataFrame:
    t = t.withColumns(_costs(p))
    rows = F.array(*[F.struct(
        F.lit(d).cast("long").alias("horizon"),
        _return(p, d).alias("ret"),
        ((F.col(f"h{d}") - F.col("cost")) / F.col("cost")).alias("mfe"),
        ((F.col(f"l{d}") - F.col("cost")) / F.col("cost")).alias("mae")) for d in horizons])
    out = t.select("sig_id", "sym", "dt", "idx", *carry, F.inline(rows))
    return out.where("ret IS NOT NULL")


def return_stats(returns: DataFrame) -> DataFrame:
    """One row per horizon; the AI-filtered rate is filled at T+3 only. Needs ``ai_prob``."""
    r = F.col("ret")
    gain = F.sum(F.when(r > 0, r).otherwise(0.0))
    loss = F.sum(F.when(r < 0, r).otherwise(0.0))
    sure = (F.col("ai_prob") >= 0.5) & (F.col("horizon") == 3)
    return returns.groupBy("horizon").agg(
        F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("avg_ret"),
        (F.avg(r) / (F.stddev_pop(r) + EPS)).alias("sharpe"), F.min(r).alias("worst_trade"),
        F.count(F.lit(1)).alias("total_trades"),
        F.when(F.sum(F.when(r < 0, 1).otherwise(0)) > 0, gain / F.abs(F.nullif(loss, F.lit(0.0)))
               ).otherwise(99.0).alias("profit_factor"),
        F.coalesce(F.avg(F.when(r > 0, F.col("mae"))), F.lit(0.0)).alias("avg_win_mae"),
        F.avg(F.when(sure, (r > 0).cast("double"))).alias("ai_win_rate"))


def losing_streak(returns: DataFrame) -> DataFrame:
    """horizon, max_cons_loss in (dt, sig_id) order; a zero return breaks the run.

    A run is the losses that share a count of non-losses before them. The count is a distributed
    running sum, and the runs are sized by aggregation, so no task holds the whole log.
    """
    run = prefix_sum(returns.select("horizon", "dt", "sig_id", "ret"),
                     [F.col("horizon"), F.col("dt"), F.col("sig_id")],
                     {"island": F.when(F.col("ret") < 0, 0).otherwise(1).cast("long")}, ["horizon"])
    sizes = run.groupBy("horizon", "island").agg(
        F.sum((F.col("ret") < 0).cast("long")).alias("losses"))
    return sizes.groupBy("horizon").agg(F.max("losses").alias("max_cons_loss"))


def factor_stats(returns: DataFrame, horizon: int = 3) -> DataFrame:
    """Per factor tag at T+3, tags with at least two trades. Needs ``factors``."""
    e = returns.where(F.col("horizon") == horizon).select("ret", F.explode("factors").alias("factor"))
    r = F.col("ret")
    loss = F.sum(F.when(r < 0, r).otherwise(0.0))
    return e.groupBy("factor").agg(
        F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("avg_ret"),
        F.count(F.lit(1)).alias("n"),
        F.when(F.sum(F.when(r < 0, 1).otherwise(0)) > 0,
               F.sum(F.when(r > 0, r).otherwise(0.0)) / F.abs(F.nullif(loss, F.lit(0.0)))
               ).otherwise(99.0).alias("profit_factor")).where("n >= 2")


def attribution(returns: DataFrame, factors: tuple[str, ...] = ATTRIBUTION_FACTORS,
                baseline: str = BASELINE_FACTOR, min_trades: int = 30) -> DataFrame:
    """Per factor: median premium in basis points, correlation with the baseline tag, trigger
    rate, diagnosis. Empty under ``min_trades`` trades."""
    base = returns.where("horizon = 3")
    flags = base.select("ret", F.array_contains("factors", baseline).cast("double").alias("b"), *[
        F.array_contains("factors", f).cast("double").alias(f) for f in factors])
    long = materialise(flags.unpivot(["ret", "b"], list(factors), "factor", "flag"))
    med = exact_quantiles(long, ["factor", "flag"], "ret", {"med": 0.5}).groupBy("factor").agg(
        F.max(F.when(F.col("flag") == 1, F.col("med"))).alias("on"),
        F.max(F.when(F.col("flag") == 0, F.col("med"))).alias("off"))
    x, y, n = F.col("flag"), F.col("b"), F.count(F.lit(1))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    rest = long.groupBy("factor").agg(
        n.alias("n"), F.avg(x).alias("trigger_rate"),
        F.coalesce(F.try_divide(F.covar_pop(x, y), spread), F.lit(0.0)).alias("corr_with_baseline"))
    out = rest.where(F.col("n") >= min_trades).join(med, "factor").select(
        "factor", F.coalesce((F.col("on") - F.col("off")) * 10000.0, F.lit(0.0)).alias("premium_bps"),
        "corr_with_baseline", "trigger_rate")
    p, c = F.col("premium_bps"), F.col("corr_with_baseline")
    return out.withColumn("diagnosis", F.when(p < 0, "negative premium").when(c > 0.6, "highly coupled")
                          .when((p > 50) & (c < 0.4), "pure alpha").otherwise("useful gain"))


def headline(stats: DataFrame) -> DataFrame:
    """The T+3 row as dashboard metrics with defaults."""
    return stats.groupBy().agg(*[
        F.coalesce(F.max(F.when(F.col("horizon") == 3, F.col(c))), F.lit(d)).alias(c)
        for c, d in (("win_rate", 0.0), ("profit_factor", 0.0))],
        F.max(F.when(F.col("horizon") == 3, F.col("ai_win_rate"))).alias("ai_win_rate"))


def training_samples(returns: DataFrame, bars: DataFrame, horizon: int = 3) -> DataFrame:
    """sig_id, sym, dt, seq, label: tensor of the last bar on or before the signal date, with the
    horizon's return; all-zero tensors are dropped.

    Signals collapse to distinct (sym, dt), meet their bar by an as-of join, and only the bars that
    are asked for get a tensor.
    """
    picks = returns.where(F.col("horizon") == horizon).select("sig_id", "sym", "dt", "ret")
    at = materialise(asof_join(picks.select("sym", "dt").distinct(), bars.select("sym", "dt"), "sym", F.col("dt"), F.col("dt"),
                               {"bar_dt": F.col("dt")}))
    asked = at.where("bar_dt IS NOT NULL").select("sym", F.col("bar_dt").alias("dt")).distinct()
    full = sequence_tensor(bars, asked).where(F.exists("seq", lambda row: F.exists(row, lambda x: x != 0)))
    hit = picks.join(at, ["sym", "dt"]).join(full.withColumnRenamed("dt", "bar_dt"), ["sym", "bar_dt"])
    return hit.select("sig_id", "sym", "dt", "seq", F.col("ret").alias("label"))


def enough(df: DataFrame, n: int) -> DataFrame:
    """``df`` when it has at least ``n`` rows, otherwise nothing (decided by a counted flag row)."""
    size = df.agg((F.count(F.lit(1)) >= n).alias("_ok"))  # one row
    return df.crossJoin(F.broadcast(size)).where("_ok").drop("_ok")


