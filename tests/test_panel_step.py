"""The panel reads its bars once: what was joined to them is laid beside them or made in the series step, with the same values."""

from __future__ import annotations

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from compare import SF
from sigloom.operators import bars as ob
from sigloom.operators import backtest, features, scenarios, scoring
from sigloom.plans import catalog
from sigloom.plans.catalog import QUERIES
from sigloom.plans.panel import feature_panel
from sigloom.sources import fixtures as fx

D0 = dt.date(2020, 1, 6)
OHLCV = "sym long, dt date, open double, high double, low double, close double, volume double"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["factor_vector", "factors_long", "triggers_long"])
def test_bars_meet_no_join_on_their_dates(spark, name):
    plan = physical(QUERIES[name](spark, SF))
    assert not re.search(r"Join \[(sym|_k)#\d+L?, (dt|_wk|_mo)#", plan)
    assert plan.count("FileScan parquet [l_orderkey") == 1


@pytest.mark.parametrize("live", [False, True])
def test_periods_and_hours_equal_the_joins(spark, bars, live):
    hours = ob.hourly_bars(fx.panel_ticks(spark, SF))
    panel = feature_panel(bars, fx.macro(spark, SF), hourly=hours, statistics=False, live=live, min_bars=1)
    cols = ["sym", "dt", *features.PERIODS, "rsi_60m", "rsi_60m_bounce"]
    want = features.with_hourly(features.with_periods(bars.select("sym", "dt"), bars, live), hours).select(*cols)
    got, want = panel.select(*cols), want
    assert got.count() == bars.count() and got.exceptAll(want).count() == 0
    assert {k for k in features.PERIODS if got.where(k).count()} == {k for k in features.PERIODS if want.where(k).count()}


def test_snapshot_counts_on_the_newest_bar(spark):
    rows = [(s, D0 + dt.timedelta(days=k), 10.0, 12.0, 9.0, 11.0 + k % 3, 5.0) for s in (1, 2) for k in range(5)]
    snap = spark.createDataFrame([(1, 2.5, None), (9, 4.0, 1.0)], "sym long, pcr double, insider double")
    panel = feature_panel(spark.createDataFrame(rows, OHLCV), fx.macro(spark, SF), alt=snap, statistics=False, min_bars=1)
    got = {(r["sym"], r["dt"]): (r["pcr"], r["insider"]) for r in panel.collect()}
    newest = D0 + dt.timedelta(days=4)
    assert len(got) == 10  # a snapshot without bars makes no row
    assert got.pop((1, newest)) == (2.5, 0.0) and set(got.values()) == {(1.0, 0.0)}


def test_missing_prices_in_weeks_and_months(spark):
    rng = np.random.default_rng(2)
    rows = [(1, D0 + dt.timedelta(days=3 * k), *(float(x) for x in 100 + rng.normal(size=4).cumsum()), 5.0) for k in range(400)]
    rows = [(s, d, o, max(o, h, lo, c), min(o, h, lo, c), c, v) for s, d, o, h, lo, c, v in rows]
    rows[7] = (1, rows[7][1], None, None, None, None, None)
    b = spark.createDataFrame(rows, OHLCV)
    panel = feature_panel(b, fx.macro(spark, SF), statistics=False, min_bars=1).select("sym", "dt", *features.PERIODS)
    want = features.with_periods(b.select("sym", "dt"), b, live=True).select(panel.columns)
    assert panel.exceptAll(want).count() == 0 and panel.where(F.col("weekly_bullish")).count()


def test_scan_writes_numbers_alone(spark):
    plan = physical(QUERIES["daily_scan"](spark, SF))
    stored = {c.split("#")[0] for cols in re.findall(r"Scan ExistingRDD\[([^\]]*)\]", plan) for c in cols.split(",")}
    assert "raw_score" in stored and not stored & {"signals", "factors", "vec", "notes"}


def test_earnings_beside_bars_equal_the_join(spark, bars):
    e = fx.earnings(spark, SF)
    panel = feature_panel(bars, fx.macro(spark, SF), statistics=False, min_bars=1, earnings=e).select("sym", "dt", "earnings_soon")
    want = scoring.earnings_flag(bars.select("sym", "dt"), e)
    assert panel.count() == want.count() and panel.exceptAll(want).count() == 0 and 0 < panel.where("earnings_soon").count() < panel.count()


@pytest.mark.parametrize("name", ["ic_daily", "ic_summary", "factor_select"])
def test_ic_rows_meet_no_join_on_their_dates(spark, name):
    plan = physical(QUERIES[name](spark, SF))
    assert not re.search(r"Join \[(sym|_k)#\d+L?, (dt|idx|_wk|_mo)#", plan) and plan.count("FileScan parquet [l_orderkey") == 1


def test_return_on_bars_equals_trade_returns(spark):
    bars = fx.daily_bars(spark, SF, fx.WILD)
    cal = ob.calendar(bars)
    got = backtest.with_return(bars.join(cal, "dt"), cal)
    ids = bars.select("sym", "dt", F.concat_ws("|", "sym", "dt").alias("sig_id"))
    want = {(r["sym"], r["dt"]): r["ret"] for r in backtest.trade_returns(ids, bars, horizons=(3,)).collect()}
    rows = {(r["sym"], r["dt"]): r["ret"] for r in got.collect()}
    assert len(rows) == bars.count() and want and {k: v for k, v in rows.items() if v is not None} == want


def test_scenarios_take_one_exchange(spark, bars):
    plan = physical(scenarios.scenario_trades(bars))
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan


def test_scenarios_of_a_symbol_equal_the_operators(spark, bars):
    some = bars.where("sym <= 2")
    rows = some.orderBy("dt").collect()
    for name, df in (("Phase_Chaos", scenarios.phase_scenario(some)), ("Noise_Explosion", scenarios.noise_scenario(some))):
        want = {(r["sym"], r["dt"]): r for r in df.collect()}
        for sym in {r["sym"] for r in rows}:
            own = [r for r in rows if r["sym"] == sym]
            b = {x: np.array([r[x] for r in own]) for x in (*scenarios.PRICES, "volume")}
            got = dict(scenarios.scenario_columns(b, sym, 10))
            assert list(got) == list(scenarios.SCENARIOS) and not scenarios.scenario_columns(b, sym, len(own) + 1)
            for x in scenarios.PRICES:
                assert np.allclose(got[name][x], [want[sym, r["dt"]][x] for r in own], rtol=1e-11)
                assert got["Original"][x] is b[x]


def test_stack_rows_carry_the_picks(spark):
    rows = catalog._stack_rows(spark, SF)
    assert not re.search(r"Join \[sym#\d+L?, (dt|idx|_wk|_mo)#", physical(rows))
    got = {r["sig_id"]: r["exact"] for r in rows.where("picked").select("sig_id", "exact").collect()}
    old = fx.daily_bars(spark, SF, fx.WILD).withColumn("n", F.row_number().over(Window.partitionBy("sym").orderBy("dt")))
    want = catalog._t3(spark, SF).join(old.where("n >= 60").select("sym", "dt"), ["sym", "dt"])
    assert got and got == {r["sig_id"]: r["ret"] for r in want.select("sig_id", "ret").collect()}
