"""Plans of the steps whose exchanges were cut down, and their results on odd rows."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from compare import SF
from sigloom.operators import backtest, evaluation, statistics
from sigloom.plans.catalog import QUERIES
from sigloom.sources import fixtures as fx

D0 = dt.date(2020, 1, 6)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_returns_make_no_row_for_each_offset(spark, bars):
    sig = bars.select(F.monotonically_increasing_id().alias("sig_id"), "sym", "dt")
    assert plan(backtest.trade_returns(sig, bars)).count("Generate") == 1


def test_returns_at_the_end_and_twice_a_day(spark):
    bars = spark.createDataFrame([(1, D0 + dt.timedelta(days=k), 10.0 + k, 12.0 + k, 9.0 + k, 11.0 + k, 5.0) for k in range(4)],
                                 "sym long, dt date, open double, high double, low double, close double, volume double")
    asked = [(1, D0 + dt.timedelta(days=2)), (2, D0 + dt.timedelta(days=2)), (3, D0 + dt.timedelta(days=3)), (4, D0 + dt.timedelta(days=9))]
    sig = spark.createDataFrame([(i, 1, d) for i, d in asked], "sig_id long, sym long, dt date")
    r = {(x["sig_id"], x["horizon"]): x for x in backtest.trade_returns(sig, bars).collect()}
    assert set(r) == {(i, h) for i in (1, 2, 3) for h in (1, 3, 5)}
    assert r[(1, 3)][4:] == r[(2, 3)][4:] and r[(3, 5)]["mae"] is None
    cost = 13.0 * 1.0035  # next open; closes beyond the calendar are its last one
    assert r[(1, 5)]["ret"] == pytest.approx((14.0 * 0.9965 - cost) / (cost + 1e-9), rel=1e-6)
    assert r[(1, 5)]["mfe"] == pytest.approx((15.0 - cost) / cost) and r[(1, 5)]["mae"] == pytest.approx((12.0 - cost) / cost)


def test_price_walk_takes_two_levels(spark):
    assert plan(fx.ticks(spark, SF)).count("Window ") == 2


def test_wide_ranks_equal_long_ranks(spark):
    rng = np.random.default_rng(3)
    wide = pd.DataFrame(rng.integers(0, 6, (90, 11)) / 4.0, columns=[f"f{k}" for k in range(11)])
    wide["f3"] = 1.0  # constant: 0
    wide.loc[::7, "f5"] = np.nan
    wide["dt"] = [D0 + dt.timedelta(days=k % 4) for k in range(90)]
    wide.loc[wide.index[wide["dt"] == D0][4:], "dt"] = D0 + dt.timedelta(days=1)  # four rows are too few
    wide["ret"] = rng.normal(size=90).round(1)
    wide.loc[5, "ret"] = np.nan
    df = spark.createDataFrame(wide).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("f5", "ret")})
    names = tuple(f"f{k}" for k in range(11))
    long = df.unpivot(["dt", "ret"], list(names), "factor", "value")
    want = {(r["dt"], r["factor"]): r["ic"] for r in evaluation.rank_ic(long).collect()}
    got = {(r["dt"], r["factor"]): r["ic"] for r in evaluation.rank_ic_wide(df, names).collect()}
    assert got.keys() == want.keys() and len(got) == 33 and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in got)


def test_panel_exchanges_no_wide_row(spark):
    physical = QUERIES["score_core"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert physical.count("FlatMapGroupsInArrow") == 1
    above = physical[:physical.index("FlatMapGroupsInArrow")]
    assert "SortMergeJoin" not in above and "Exchange" not in above


def test_young_and_grown_bars_share_sub_windows():
    """Each bar's exponents against the plain definition, around the row where the window is full."""
    price = 100 * np.exp(np.cumsum(np.random.default_rng(5).integers(-5, 6, 140)) * 0.01)
    med, iqr, _ = statistics.memory(price)
    r = np.diff(np.log(price))
    for row in (31, 60, 119, 120, 121, 139):
        x = r[max(row - 120, 0):row]
        h = []
        for s, n in zip(*statistics.samples(len(x))):
            w = x[s:s + n]
            path = np.cumsum(w - w.mean())
            h.append(np.log((path.max() - path.min()) / w.std()) / np.log(n))
        a, b, c = np.percentile(h, [25, 50, 75])
        assert med[row] == pytest.approx(b, abs=1e-9) and iqr[row] == pytest.approx(c - a, abs=1e-9)
    assert set(map(len, statistics.GROWN.values())) <= {1, 2} and sum(map(len, statistics.GROWN.values())) == 100
