"""Row-level checks on small invented tables, and properties of the operators."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigloom.functions import scan
from sigloom.functions.scalar import safe_div, scrub
from sigloom.functions.windows import index_series, span, with_ewm
from sigloom.operators import backtest, bars as B, contrastive, evaluation, learn, orders, scoring
from sigloom.operators.indicators import indicators

D0 = dt.date(2020, 1, 1)
DDL = "sym long, dt date, open double, high double, low double, close double, volume double"


def make(spark, closes, sym=1, highs=None, lows=None, opens=None, volumes=None):
    n = len(closes)
    rows = [(sym, D0 + dt.timedelta(days=k), float((opens or closes)[k] or 1) if (opens or closes)[k] else None,
             (highs or closes)[k], (lows or closes)[k], closes[k], (volumes or [100.0] * n)[k]) for k in range(n)]
    return spark.createDataFrame(rows, DDL)


def col(df, name):
    return [r[name] for r in df.orderBy("dt").select(name).collect()]


def test_safe_div_and_scrub(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 1.0), (100.0, 1.0), (-100.0, 1.0), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_div(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 20.0, -20.0, 0.5]
    x = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (3.0,)], "x double")
    assert [r[0] for r in x.select(scrub(F.col("x"), 5)).collect()] == [0.0, 5.0, -5.0, 0.0, 3.0]


def test_ewm_matches_pandas_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    x = 100 + rng.normal(size=2000).cumsum()
    df = make(spark, [float(v) for v in x])
    got = with_ewm(index_series(df), {"a": ("close", span(60), False), "b": ("close", span(5), True)})
    s = pd.Series(x)
    assert np.allclose(col(got, "a"), s.ewm(span=60, adjust=False).mean(), rtol=1e-12)
    assert np.allclose(col(got, "b"), s.ewm(span=5).mean(), rtol=1e-12)


def test_constant_series(spark):
    ind = indicators(make(spark, [10.0] * 25))
    r = ind.orderBy(F.desc("dt")).first()
    assert r["BB_Upper"] == r["BB_Lower"] == 10.0 and r["RSI"] == 0.0 and r["CMF"] == 0.0


def test_forward_fill_of_gaps(spark):
    c = [float(k) for k in range(1, 13)]
    c[5] = None
    v = [100.0] * 12
    v[7] = None
    ind = indicators(make(spark, c, highs=c, lows=c, opens=c, volumes=v))
    assert col(ind, "close")[5] == 5.0 and col(ind, "volume")[7] == 100.0


def test_order_block_expires(spark):
    c = [100.0] * 25 + [110.0] + [110.0] * 22
    v = [100.0] * 25 + [500.0] + [100.0] * 22
    got = col(indicators(make(spark, c, volumes=v)), "OB_High")
    assert got[24] is None and got[25] == 100.0 and got[45] == 100.0 and got[46] is None


def test_no_future_rows(spark, bars):
    """Appending bars must not change the past."""
    one = bars.where("sym = 1")
    cut = one.agg(F.date_sub(F.max("dt"), 300).alias("d")).first()["d"]
    cols = ["dt", "VPT_Accel", "RSI", "SenkouA", "CVD_Divergence", "Dist_52W_High"]
    full = indicators(one).where(F.col("dt") <= F.lit(cut)).select(cols).orderBy("dt").collect()
    past = indicators(one.where(F.col("dt") <= F.lit(cut))).select(cols).orderBy("dt").collect()
    assert full == past


def test_partitioning_does_not_matter(spark, bars):
    a = indicators(bars.repartition(7)).agg(F.sum("RSI"), F.sum("CVD_Smooth")).first()
    b = indicators(bars.coalesce(1)).agg(F.sum("RSI"), F.sum("CVD_Smooth")).first()
    assert np.allclose(list(a), list(b), rtol=1e-12)


def skewed(spark, n=3000):
    """One group holds a third of the rows, with many equal values."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).alias("g"), "id",
        (F.col("id") * 37 % 11).cast("double").alias("v"))


def test_row_index_and_prefix_sum(spark):
    df = skewed(spark)
    ix = scan.row_index(df, [F.col("v"), F.col("id")]).orderBy("v", "id").collect()
    assert [r["idx"] for r in ix] == list(range(3000))
    ps = scan.prefix_sum(df, [F.col("g"), F.col("v"), F.col("id")], {"s": F.col("v")}, ["g"]).toPandas()
    ps = ps.sort_values(["g", "v", "id"])
    assert np.allclose(ps["s"], ps.groupby("g")["v"].cumsum())


def test_average_rank_leaves_nulls_out(spark):
    df = skewed(spark).withColumn("v", F.when(F.col("id") % 7 != 0, F.col("v")))
    a = scan.average_rank(df, ["g"], "v", "r").orderBy("id").toPandas()
    assert len(a) == 3000
    assert np.allclose(a["r"], a.groupby("g")["v"].rank(), equal_nan=True)


def test_exact_quantiles(spark):
    df = skewed(spark)
    got = scan.exact_quantiles(df, ["g"], "v", {"q": 0.3}).toPandas().set_index("g")["q"].sort_index()
    want = df.toPandas().groupby("g")["v"].quantile(0.3)
    assert np.allclose(got, want)


def test_losing_streak(spark):
    rets = [-1.0, -1.0, 0.0, -1.0, 1.0, -1.0, -1.0, -1.0]
    df = spark.createDataFrame([(3, D0 + dt.timedelta(days=k), k, r) for k, r in enumerate(rets)],
                               "horizon long, dt date, sig_id long, ret double")
    assert backtest.losing_streak(df).first()["max_cons_loss"] == 3


def test_returns_use_the_union_calendar(spark):
    """Symbol 2 has no bar on the third date: its T+1 from date 2 is missing, the end is clamped."""
    a = make(spark, [100.0, 101.0, 102.0, 103.0])
    b = make(spark, [50.0, 51.0, 52.0, 53.0], sym=2).where(F.col("dt") != F.lit(D0 + dt.timedelta(days=2)))
    sig = spark.createDataFrame([(1, 1, D0), (2, 2, D0 + dt.timedelta(days=1)), (3, 1, D0 + dt.timedelta(days=3)),
                                 (4, 2, D0 - dt.timedelta(days=9))], "sig_id long, sym long, dt date")
    r = {(x["sig_id"], x["horizon"]): x for x in backtest.trade_returns(sig, a.union(b)).collect()}
    cost = 101.0 * 1.0035
    assert r[(1, 1)]["ret"] == pytest.approx((101.0 * 0.9965 - cost) / cost)
    assert r[(1, 3)]["mfe"] == pytest.approx((103.0 - cost) / cost)
    assert (2, 1) not in r and r[(3, 1)]["mfe"] is None and r[(4, 1)]["idx"] == 0


def test_ic_skips_small_days_and_averages_ties(spark):
    rows = [(D0, "f", v, r) for v, r in ((1.0, 0.1), (1.0, 0.2), (2.0, 0.3), (3.0, 0.2), (4.0, 0.5))]
    rows += [(D0 + dt.timedelta(days=1), "f", float(k), float(k)) for k in range(4)]
    df = spark.createDataFrame(rows, "dt date, factor string, value double, ret double")
    got = evaluation.rank_ic(df).collect()
    s = pd.DataFrame(rows[:5], columns=["dt", "f", "v", "r"])
    assert len(got) == 1 and got[0]["ic"] == pytest.approx(s["v"].rank().corr(s["r"].rank()))


def test_crowding_and_weights(spark):
    rows = [("a", 50, "X"), ("b", 50, "X"), ("c", 40, "X"), ("d", 30, "Y"), ("e", 60, "QQQ"), ("f", 20, "QQQ")]
    df = spark.createDataFrame([(D0, s, v, sec, 1.0) for s, v, sec in rows],
                               "dt date, sym string, score int, sector string, health double")
    got = {r["sym"]: r["score"] for r in scoring.crowd(df).collect()}
    assert got == {"a": 50, "b": 45, "c": 36, "d": 30, "e": 60, "f": 20}
    w = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "p double").select(scoring.kelly_weight(F.col("p"))).collect()
    assert [round(r[0], 4) for r in w] == [0.02, 0.0333, 0.12]


def test_order_state_is_final(spark):
    t = dt.datetime(2024, 1, 1)
    ev = [(1, 1, t, "OPEN", 1.0, 7), (1, 2, t, "FILLED", 2.0, None), (1, 3, t, "OPEN", 3.0, None), (2, 4, t, "OPEN", 4.0, None)]
    df = spark.createDataFrame(ev, "client_oid long, seq long, ts timestamp, status string, price double, broker_oid long")
    got = {r["client_oid"]: (r["status"], r["price"], r["broker_oid"]) for r in orders.latest_state(df).collect()}
    assert got == {1: ("FILLED", 2.0, 7), 2: ("OPEN", 4.0, None)}


def test_triplets_draw_the_other_class(spark):
    df = spark.range(60).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"),
                                (F.col("id") % 3 - 1).cast("int").alias("cls"))
    t = contrastive.triplets(df).join(df.select(F.col("id").alias("neg_id"), F.col("cls").alias("nc")), "neg_id").collect()
    assert len(t) == 60 and all(r["nc"] == -r["cls"] for r in t if r["cls"] != 0)
    assert all(r["nc"] != 0 for r in t)


def test_purged_split_falls_back(spark):
    df = spark.range(100).select(F.col("id").alias("sig_id"))
    n = {r["part"]: r["count"] for r in learn.purged_split(df, [F.col("sig_id")]).groupBy("part").count().collect()}
    assert n == {"train": 80, "valid": 20}


def test_dedupe_keeps_the_last_copy(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "z")], "k long, seq long, v string")
    assert {r["k"]: r["v"] for r in B.dedupe_last(df, ["k"], "seq").collect()} == {1: "c", 2: "z"}
