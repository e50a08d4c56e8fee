"""Registered queries against their SQL twins (a cross-section; tests/compare.py runs them all)."""

from __future__ import annotations

import pytest
from compare import SF, diff

NAMES = ("bars_daily", "bars_weekly", "bars_hourly", "dedupe_last", "close_history", "ind_ema", "ind_orderblock",
         "ind_cvd", "market_context", "feat_rel_strength", "feat_weekly", "feat_kde", "feat_hurst", "alt_skew",
         "alt_analyst", "alt_mentions", "score_core", "daily_top5", "bt_stats", "bt_streak", "bt_attribution",
         "ts_folds", "triplet_loss", "scen_noise", "order_latest", "tca_hist", "stacked_averages",
         "asof_hourly", "feat_periods_live", "feat_fft", "seq_tensor", "train_samples", "daily_scan", "bt_from_log", "scen_phase")


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    from sigloom.plans.catalog import QUERIES
    from sigloom.plans.oracle_sql import SQL
    assert diff(QUERIES[name](spark, SF), con, SQL[name]) == ""


def test_entry_and_names(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
