"""Columns made in a symbol's Arrow group: frames, ties, pruned statistics, no window and no second exchange."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from sigloom.functions.series import cov, ewm, lag, roll
from sigloom.operators import statistics, tensors
from sigloom.operators.indicators import indicators, levels
from sigloom.plans.panel import series_features


@pytest.mark.parametrize("n", [1, 2, 3, 7, 20, 22, 252])
def test_frames_equal_pandas(n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=400)
    x[rng.random(400) < 0.1] = np.nan
    for kind in ("max", "min", "sum", "mean"):
        for m in {1, n}:
            want = getattr(pd.Series(x).rolling(n, m), kind)()
            assert np.allclose(roll(kind, x, n, m), want, equal_nan=True), (kind, n, m)


def test_frames_keep_nothing_of_earlier_rows():
    x = np.array([1e300] + [0.1] * 60)
    assert roll("sum", x, 20)[-1] == pytest.approx(2.0, rel=1e-14)


def test_equal_frames_give_equal_averages():
    x = 100 + np.random.default_rng(5).normal(size=140).cumsum()
    assert (roll("mean", x, 150, 30)[29:] == roll("mean", x, 200, 30)[29:]).all()


def test_averages_and_covariance_equal_pandas():
    x, y = pd.Series(np.random.default_rng(6).normal(size=(2, 1500)).tolist()).map(pd.Series)
    assert np.allclose(ewm(x.to_numpy(), 2 / 13, 0), x.ewm(span=12, adjust=False).mean(), rtol=1e-12)
    assert np.allclose(cov(x.to_numpy(), y.to_numpy(), 60), x.rolling(60).cov(y), equal_nan=True)
    flat = np.full(60, 0.1)
    assert cov(flat, flat, 20)[-1] == 0 and np.isnan(lag(np.ones(2))[0])


def test_one_exchange_and_only_what_is_asked(spark, bars):
    kde = statistics.with_statistics(bars, ("kde",))
    assert "fft_ensemble_score" not in kde.columns and "hurst_med" not in kde.columns
    for df in (indicators(bars), kde, tensors.score_sequences(bars, lambda x: x[:, 0, :16])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(sym") == 1 and "Window" not in plan, plan


def test_levels_equal_the_indicators(spark, bars):
    cols = ["sym", "dt", "close", "volume", "ATR", "Chandelier_Exit", "SMA_200"]
    some = bars.where("sym <= 3")
    assert levels(some).columns == cols and set(levels(some).collect()) == set(indicators(some).select(*cols).collect())


def test_wide_steps_are_compiled(spark, bars):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    series_features(bars, statistics=False)
    # HotSpot leaves longer methods to the interpreter
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
