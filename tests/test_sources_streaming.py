"""Readers on hand-made files; streams against batch runs of the same rows."""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
import pytest
from compare import SF
from pyspark.sql import functions as F

from sigloom.operators import backtest, bars as B, orders
from sigloom.params import ALL_FACTORS
from sigloom.sources import fixtures as fx, tables
from sigloom.streaming import bars as SB, orders as SO


def rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_pick_log(spark, tmp_path):
    pick = {"symbol": "A", "score": 9, "ai_prob": 0.6, "signals": ["[Trend x] up"], "factors": [], "ml_features": {"cmf": 0.5}}
    listed = {**pick, "symbol": "B", "ml_features": [1.0, 2.0]}
    lines = [json.dumps({"date": "2024-01-02", "vix": 21.0, "macro_meta": {"market_pcr": 0.8}, "top_picks": [pick],
                         "shadow_pool": [listed]}), "{broken", json.dumps({"date": "2024-01-03", "top_picks": [pick]})]
    (tmp_path / "backtest_log_a.jsonl").write_text("\n".join(lines))
    log = tables.read_pick_logs(spark, f"{tmp_path}/backtest_log*.jsonl")
    got = backtest.factor_tags(backtest.flatten_picks(log)).orderBy("dt", "sym").collect()
    assert [(str(r["dt"]), r["sym"], r["vix"], r["pcr"]) for r in got] == [
        ("2024-01-02", "A", 21.0, 0.8), ("2024-01-02", "B", 21.0, 0.8), ("2024-01-03", "A", 18.0, 1.0)]
    assert got[0]["factors"] == ["Trend"] and got[0]["ml_features"] == {"cmf": 0.5}
    assert got[1]["ml_features"][ALL_FACTORS[1]] == 2.0 and len(got[1]["ml_features"]) == 64


def test_provider_json_and_bar_table(spark, tmp_path):
    doc = json.dumps({"bars": {"A": [{"t": "2024-01-02T05:00:00Z", "o": 1, "h": 3, "l": 1, "c": 2, "v": 10}]}})
    b = tables.flatten_provider_json(spark.createDataFrame([(doc,)], "json string"))
    tables.write_bars(b.withColumn("freq", F.lit("1d")), f"{tmp_path}/bars")
    back = tables.read_bars(spark, f"{tmp_path}/bars").collect()
    assert len(back) == 1 and back[0]["close"] == 2.0
    assert tables.read_bars(spark, f"{tmp_path}/bars", "60m").count() == 0


def test_samples_append_is_idempotent(spark, tmp_path):
    s = spark.range(5)
    for day in ("2024-01-01", "2024-01-02", "2024-01-02"):
        tables.append_samples(s, f"{tmp_path}/s", day)
    assert spark.read.parquet(f"{tmp_path}/s").count() == 10


@pytest.fixture
def events_dir(spark, tmp_path):
    """The events in four files in order of their id, each read as a micro-batch of its own."""
    d = tmp_path / "events"
    d.mkdir()
    e = pd.read_parquet(f"{SF}/events.parquet").sort_values("event_id")
    for k, part in enumerate(np.array_split(e, 4)):
        part.to_parquet(d / f"{k}.parquet", index=False, coerce_timestamps="us")
        os.utime(d / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return str(d)


def streamed(spark, d):
    schema = spark.read.parquet(d).schema
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d)
    status = (F.when(F.col("event_type") == "signup", "PENDING_SUBMIT").when(F.col("event_type") == "purchase", "FILLED")
              .when(F.col("event_type") == "error", "REJECTED").otherwise("OPEN"))
    return e.select(F.col("user_id").alias("client_oid"), F.col("event_id").alias("seq"),
                    F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), F.col("value").alias("price"),
                    F.when(F.col("event_type") == "click", F.col("event_id")).alias("broker_oid"))


def test_order_state_stream(spark, events_dir, tmp_path):
    q = SO.state_stream(streamed(spark, events_dir), f"{tmp_path}/state", f"{tmp_path}/cp")
    q.awaitTermination(120)
    want = orders.latest_state(fx.order_events(spark, SF)).drop("n_events")
    assert rows(SO.read_state(spark, f"{tmp_path}/state").drop("n_events")) == rows(want)


def test_late_summary_keeps_the_newest_broker_id(spark, tmp_path):
    schema = "client_oid long, seq long, ts timestamp, status string, price double, broker_oid long"
    for k, part in enumerate(([(1, 5, None, "OPEN", 1.0, 55), (1, 9, None, "OPEN", 1.0, None)], [(1, 7, None, "OPEN", 1.0, 77)],
                              [(1, 6, None, "OPEN", 1.0, 66), (1, 8, None, "OPEN", 1.0, None)])):
        orders.latest_state(spark.createDataFrame(part, schema)).write.parquet(f"{tmp_path}/s/batch_id={k}")
    r = SO.read_state(spark, f"{tmp_path}/s").first()
    assert (r["seq"], r["broker_oid"], r["n_events"]) == (9, 77, 5)
    SO.compact_state(spark, f"{tmp_path}/s", f"{tmp_path}/c")
    assert rows(SO.read_state(spark, f"{tmp_path}/c")) == rows(SO.read_state(spark, f"{tmp_path}/s"))


def test_tca_stream_equals_batch(spark, events_dir, tmp_path):
    o = fx.orders(spark, SF)
    q = SO.finals_stream(streamed(spark, events_dir), f"{tmp_path}/f", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert sum(p["numInputRows"] > 0 for p in q.recentProgress) >= 3
    got = SO.streamed_tca(spark, f"{tmp_path}/f", o)
    want = orders.tca_rows(orders.first_fills(fx.order_events(spark, SF)), o)
    assert rows(got) == rows(want) and got.count() == got.select("client_oid").distinct().count() > 0
    h = SO.slippage_histogram_stream(got, 5.0)
    assert h.agg(F.sum("n")).first()[0] == got.count()


def test_bar_stream_matches_batch(spark, events_dir):
    e = spark.readStream.schema(spark.read.parquet(events_dir).schema).option("maxFilesPerTrigger", 1).parquet(events_dir)
    t = e.select(F.col("user_id").alias("sym"), F.col("ts").cast("timestamp").alias("ts"),
                 F.col("event_id").alias("seq"), F.col("value").alias("px"), F.lit(1.0).alias("q"))
    q = SB.bar_stream(t).writeStream.format("memory").queryName("bars_out").outputMode("complete").trigger(
        availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("bars_out")) == rows(B.hourly_bars(fx.hourly_ticks(spark, SF)))
