"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sigloom.plans.catalog import QUERIES  # noqa: E402
from sigloom.session import local_session  # noqa: E402

HEADLINE = ("bars_daily", "ind_macd", "feat_beta", "feat_fft", "alt_analyst", "tca_slippage", "daily_top5",
            "bt_stats", "score_core", "asof_hourly", "seq_scores", "scen_phase")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), **{
        "spark.ui.showConsoleProgress": "false", "spark.python.sql.dataFrameDebugging.enabled": "false"})
    QUERIES["bars_weekly"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in HEADLINE:
        t = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
