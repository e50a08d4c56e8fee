"""Bars and the returns of picks on them: one exchange of the ticks, the same rows as by the longer ways."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from compare import SF
from sigloom.operators import backtest
from sigloom.operators import bars as bar_ops
from sigloom.plans import catalog
from sigloom.sources import fixtures as fx


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("long_walk", [0, 590, 600, 610])
def test_long_walks_give_the_same_bars(spark, bars, long_walk):
    assert sorted(fx.daily_bars(spark, SF, long_walk=long_walk).collect()) == sorted(bars.collect())


def test_bars_take_one_exchange(spark):
    assert physical(fx.daily_bars(spark, SF)).count("Exchange hashpartitioning") == 1


def test_dates_are_those_of_the_bars(spark, bars):
    assert sorted(fx.trading_dates(spark, SF).collect()) == sorted(bars.select("dt").distinct().collect())


def test_returns_of_picks_take_the_exchange_of_the_bars(spark):
    assert physical(catalog.QUERIES["bt_returns"](spark, SF)).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("horizons", [(1, 3, 5), (3,)])
def test_returns_of_picks_equal_those_of_signals(spark, horizons):
    b = catalog.bar_table(spark, SF, fx.WILD)
    carry = ("ai_prob", "factors")
    want = backtest.trade_returns(catalog.signals(b), b, carry=carry, horizons=horizons)
    got = catalog._returns(spark, SF, carry, horizons)
    assert got.columns == want.columns
    rows = lambda df: sorted(df.withColumn("factors", F.concat_ws(",", "factors")).collect(), key=str)
    assert rows(got) == rows(want) and want.count() > 30


def test_picks_at_the_end_and_across_gaps(spark):
    """A day without a bar has no price, and days beyond the calendar are its last one."""
    days = spark.createDataFrame([(s, f"2020-01-{d:02d}", 10.0 + d, 12.0 + d, 9.0 + d, 11.0 + d) for s, d in (
        (1, 6), (1, 7), (1, 9), (2, 6), (2, 7), (2, 8), (2, 9), (2, 10), (3, 10))], "sym long, dt string, open double, high double, low double, close double")
    days = days.withColumn("dt", F.to_date("dt")).withColumn("volume", F.lit(1.0))
    cal = bar_ops.calendar(days)
    ids = days.withColumn("sig_id", F.concat_ws("|", "sym", "dt"))
    want = sorted(backtest.trade_returns(ids, days).collect(), key=str)
    got = backtest.picked_returns(days.join(cal, "dt"), cal, F.lit(True), {"sig_id": F.concat_ws("|", "sym", "dt")})
    assert sorted(got.collect(), key=str) == want and want
