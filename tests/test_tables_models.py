"""As-of join, keyed upserts, published reports, model artefacts, weights, and keyed stream state."""

from __future__ import annotations

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from compare import SF
from pyspark.sql import functions as F

from sigloom.functions.asof import asof_join
from sigloom.operators import contrastive, evaluation, factors, features, learn, orders, scoring, statistics, tensors, triggers
from sigloom.params import ALL_FACTORS, Params
from sigloom.sources import fixtures as fx, tables
from sigloom.streaming import orders as SO

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("strict", [False, True])
def test_asof_equals_search(spark, strict):
    rng = np.random.default_rng(3)
    left = [(int(s), at(int(m)), k) for k, (s, m) in enumerate(rng.integers(0, 40, (120, 2)))] + [(None, at(1), 500), (3, None, 501)]
    right = sorted({(int(s), int(m)) for s, m in rng.integers(0, 40, (80, 2))})
    r = [(s, at(m), float(s * 100 + m) if m % 5 else None) for s, m in right] + [(None, at(0), 1.0), (3, None, 2.0)]
    got = asof_join(spark.createDataFrame(left, "sym int, t timestamp, k int"), spark.createDataFrame(r, "sym int, u timestamp, v double"),
                    "sym", F.col("t"), F.col("u"), {"v": F.col("v"), "u": F.col("u")}, tolerance=600.0, strict=strict, age="age")
    assert got.count() == len(left)
    for x in got.collect():
        fits = [(u, v) for s, u, v in r if x["sym"] is not None and s == x["sym"] and u is not None and x["t"] is not None
                and (u < x["t"] or u == x["t"] and not strict) and (x["t"] - u).total_seconds() <= 600]
        newest = max(fits, default=None, key=lambda p: p[0])
        # the newest row counts, also where its value is null; one beyond the tolerance does not hide others that are nearer
        assert (x["u"], x["v"]) == (newest or (None, None)), x


def test_running_periods_only_on_the_newest_bar(spark, bars):
    done = features.with_periods(bars.select("sym", "dt"), bars)
    live = features.with_periods(bars.select("sym", "dt"), bars, live=True)
    last = bars.groupBy("sym").agg(F.max("dt").alias("last"))
    diff = live.exceptAll(done).join(last, "sym")
    assert diff.where("dt <> last").count() == 0


def test_statistics_skip_rows_before_the_first_close(spark):
    n = 200
    rng = np.random.default_rng(9)
    c = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    df = pd.DataFrame({"sym": 1, "dt": [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)], "close": c, "volume": rng.uniform(1, 9, n)})
    late = df.copy()
    late["dt"] = late["dt"] + dt.timedelta(days=3)
    head = pd.DataFrame({"sym": 1, "dt": [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(3)], "close": np.nan, "volume": np.nan})
    schema = "sym long, dt date, close double, volume double"
    both = [spark.createDataFrame([tuple(None if x != x else x for x in r) for r in d.itertuples(index=False)], schema)
            for d in (df, pd.concat([head, late]))]
    a, b = (statistics.with_statistics(x).orderBy("dt").select(*statistics.STATS).toPandas() for x in both)
    assert (b.iloc[:3] == pd.Series(statistics.STATS)).all().all()
    pd.testing.assert_frame_equal(a, b.iloc[3:].reset_index(drop=True))
    flat = statistics.with_statistics(both[0].withColumn("close", F.lit(7.0))).agg(
        F.max("fft_ensemble_score"), F.max("kde_breakout_score"), F.max("hurst_iqr"), F.min("hurst_med")).first()
    assert tuple(flat) == (0.0, 0.0, 0.0, 0.5)


def test_upsert_equals_the_fold_of_all_batches(spark, tmp_path):
    path = f"{tmp_path}/alerts"
    schema = "namespace string, sym int, ts int, payload string"
    batches = [[("a", i, k, f"{k}-{i}") for i in range(k * 5, k * 5 + 20)] + [(None, 1, k, "n"), ("a", 3, -k, "old")] for k in range(4)]
    for b in [*batches, batches[1]]:  # the last one again, as a retry would
        tables.upsert(spark.createDataFrame(b, schema), path, ["namespace", "sym"], ["ts"], buckets=8)
    tables.upsert(spark.createDataFrame([], schema), path, ["namespace", "sym"], ["ts"], buckets=8)
    want = orders.upsert_alerts(spark.createDataFrame(batches[0], schema), spark.createDataFrame(sum(batches[1:], []), schema))
    got = tables.read_upserted(spark, path)
    assert rows(got) == rows(want) and got.count() == got.select("namespace", "sym").distinct().count()
    before = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    tables.upsert(spark.createDataFrame([("a", 3, 99, "new")], schema), path, ["namespace", "sym"], ["ts"], buckets=8)
    after = {f for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    assert len(set(before) & after) >= len(before) - 1  # one bucket was written anew
    assert tables.read_upserted(spark, path).where("sym = 3 AND namespace = 'a'").first()["payload"] == "new"


def test_order_table_keeps_one_row_an_id(spark, tmp_path):
    o = fx.orders(spark, SF).select("client_oid", "side", "arrival_price", "created_at", F.lit("PENDING_SUBMIT").alias("status"))
    path = f"{tmp_path}/orders"
    tables.upsert(o, path, ["client_oid"], ["created_at"], buckets=4)
    tables.upsert(o.withColumn("status", F.lit("OPEN")).where("client_oid % 2 = 0"), path, ["client_oid"], ["created_at", "status"], buckets=4)
    back = tables.read_upserted(spark, path)
    assert back.count() == o.count() and orders.with_status(back, ["PENDING_SUBMIT"]).count() == o.where("client_oid % 2 = 1").count() + o.where(
        "client_oid % 2 = 0").where("'OPEN' < 'PENDING_SUBMIT'").count()


def test_a_report_is_read_whole_while_the_next_one_is_written(spark, tmp_path):
    path = f"{tmp_path}/report"
    one = {"stats": spark.range(3), "factors": spark.range(5)}
    tables.publish_report(one, path, 1)
    seen = tables.read_report(spark, path)
    spark.range(9).write.parquet(f"{path}/data/2/stats")  # version 2 is under way: no manifest names it
    assert {k: t.count() for k, t in tables.read_report(spark, path).items()} == {"stats": 3, "factors": 5}
    tables.publish_report({k: t.limit(1) for k, t in one.items()}, path, 2)
    assert {k: t.count() for k, t in tables.read_report(spark, path).items()} == {"stats": 1, "factors": 1}
    assert seen["factors"].count() == 5 and tables.read_report(spark, path, 1)["stats"].count() == 3
    with pytest.raises(LookupError):
        tables.read_report(spark, path, 7)


def test_sequence_model_versions_and_scores(spark, bars, tmp_path):
    rng = np.random.default_rng(1)
    models = [tensors.SequenceModel(v, rng.normal(0, 1, (49, 16))) for v in (1, 3, 2)]
    for m in models:
        m.save(spark, f"{tmp_path}/m")
    m = tensors.SequenceModel.load(spark, f"{tmp_path}/m")
    assert m.version == 3 and np.allclose(m.weights, models[1].weights)
    assert tensors.SequenceModel.load(spark, f"{tmp_path}/m", 2).version == 2
    with pytest.raises(LookupError):
        tensors.SequenceModel.load(spark, f"{tmp_path}/m", 9)
    some = bars.where("sym <= 2")
    got = {(r["sym"], r["dt"]): r["vec"] for r in tensors.score_sequences(some, m, run_rows=100).collect()}
    asked = some.groupBy("sym").agg(F.max("dt").alias("dt")).unionByName(some.groupBy("sym").agg(F.min("dt").alias("dt")))
    seqs = tensors.sequence_tensor(some, asked).collect()
    assert len(got) == some.count() and len(seqs) == 2 * some.select("sym").distinct().count()
    for r in seqs:
        x = np.array([list(v) for v in r["seq"]], np.float32)
        assert np.allclose(got[r["sym"], r["dt"]], m(x[None])[0])


def test_ten_negatives_are_drawn_evenly_by_many_anchors(spark):
    s = spark.range(20_010).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"), F.when(F.col("id") < 10, -1).otherwise(1).alias("cls"))
    t = contrastive.triplets(s)
    assert t.count() == 20_010
    per = [r["count"] for r in t.where("cls = 1").groupBy("neg_id").count().collect()]
    assert len(per) == 10 and set(per) == {2000}
    assert t.where("cls = -1").select("neg_id").distinct().count() == 10
    one = contrastive.triplets(s.where("cls = 1").limit(50))  # no negative class: all rows stand for it
    assert one.count() == 50 and one.select("neg_id").distinct().count() == 50


def test_weights_reach_score_and_tags(spark):
    imp = spark.createDataFrame([("minervini", 0.5), ("macd_cross", 0.001), ("vcp", 1 / 64)], "factor string, importance double")
    w = evaluation.weights(imp, len(ALL_FACTORS))
    assert w == {"minervini": 3.0, "macd_cross": 0.0, "vcp": 1.0}
    on = {r.tag for _, r in triggers.weighted_rules(Params(weights=w))}
    assert "macd_cross" not in on and "minervini" in on
    listed = spark.createDataFrame([(1, {"cmf": 0.5, "odd": 2.0})], "id int, ml_features map<string,double>")
    r = factors.map_to_columns(listed).first()
    assert r["cmf"] == 0.5 and r["vcp"] == 0.0 and len(r) == 65
    assert not learn.enough_trades(spark.range(29)) and learn.enough_trades(spark.range(30))


def test_stack_survives_saving(spark, tmp_path):
    rng = np.random.default_rng(2)
    n = 240
    t = pd.DataFrame({"sig_id": range(n), "dt": [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)], "minervini": rng.normal(0, 1, n),
                      "hurst": rng.normal(0, 1, n), "vix": 18.0, "cred": 0.0, "term": 1.0, "market_pcr": 1.0})
    t["ret"] = np.where(t["minervini"] + 0.3 * t["hurst"] > 0, 0.05, -0.05)
    stack = learn.fit_stack(spark.createDataFrame(t), ["minervini", "hurst"], rounds=3)
    imps = stack.importances.collect()
    assert [r["importance"] for r in imps] == sorted((r["importance"] for r in imps), reverse=True) and imps[0]["factor"] == "minervini"
    learn.save_models(stack, f"{tmp_path}/stack")
    back = learn.load_models(f"{tmp_path}/stack")
    assert learn.features_of(back["p_a"]) == ["minervini"] and learn.features_of(back["p_b"]) == ["hurst"]
    x = spark.createDataFrame([(2.0, 1.0, 0.9, 0.0, 0.0, 0.0), (-2.0, -1.0, 0.9, 0.0, 0.0, 0.0)], "minervini double, hurst double, m_vix double, m_cred double, m_term double, m_pcr double")
    up, down = (r["ai_prob"] for r in learn.probability(back, x).collect())
    assert up >= down
    page = scoring.to_html(F.lit("### A & B\n**x** `y` <z>"))
    assert spark.range(1).select(page).first()[0] == "<b>A &amp; B</b>\n<b>x</b> <code>y</code> &lt;z&gt;"


def test_picked_bars_are_read_without_an_exchange_of_bars(spark, bars, tmp_path):
    tables.write_bar_table(bars, "bucketed_bars", f"{tmp_path}/bars", buckets=4)
    picks = bars.where("sym IN (1, 3, 5)").select("sym", "dt").limit(500)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = tables.picked_bars(spark, "bucketed_bars", picks)
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert rows(got) == rows(bars.join(picks.select("sym").distinct(), "sym", "left_semi"))
        final = got._jdf.queryExecution().executedPlan().toString()
        left = final[:final.index("FileScan parquet")].splitlines()[-4:]
        assert "Bucketed: true" in final and not any("Exchange hashpartitioning(sym" in x for x in left), plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE bucketed_bars")


# --- streams ----------------------------------------------------------------------------------
EVENTS = "client_oid long, seq long, ts timestamp, status string, price double"


def streamed(spark, tmp_path, batches, schema=EVENTS):
    d = f"{tmp_path}/in"
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(d)
        for f in os.listdir(d):
            if f.endswith(".parquet") and os.path.getmtime(f"{d}/{f}") > 1_800_000_000 - 10 or f.endswith(".parquet") and f not in done:
                os.utime(f"{d}/{f}", (1_700_000_000 + k, 1_700_000_000 + k))
                done.add(f)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d)


done: set = set()


def finished(stream, sink, checkpoint):
    q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(
        availableNow=True).start()
    q.awaitTermination(180)
    return q


def test_keyed_state_emits_each_order_once(spark, tmp_path):
    batches = [
        [(1, 1, at(0), "OPEN", 1.0), (1, 2, at(1), "FILLED", 1.5), (1, 3, at(2), "FILLED", 1.7), (2, 4, at(3), "OPEN", 2.0)],
        [(1, 5, at(10), "REJECTED", 9.0), (2, 7, at(12), "REJECTED", 2.0), (2, 6, at(11), "FILLED", 2.5), (3, 8, at(13), "REJECTED", 3.0)],
        [(1, 2, at(1), "FILLED", 1.5), (3, 9, at(20), "FILLED", 3.3), (4, 10, at(21), "FILLED", 4.0), (4, 11, at(0), "FILLED", 4.4)],
    ]
    o = spark.createDataFrame([(k, "S", "BUY", 1.0, 1.0) for k in range(1, 5)], "client_oid long, symbol string, side string, qty double, arrival_price double")
    q = finished(SO.tca_stream(streamed(spark, tmp_path, batches), o), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sum(p["numInputRows"] > 0 for p in q.recentProgress) >= 3
    got = spark.read.parquet(f"{tmp_path}/out")
    every = spark.createDataFrame(sum(batches, []), EVENTS).withColumn("broker_oid", F.lit(None).cast("long"))
    assert rows(got) == rows(orders.tca_rows(orders.first_fills(every), o)) and got.count() == 3


def test_streamed_histogram_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    batches = [[(float(x), "BUY" if k % 2 else "SELL") for k, x in enumerate(rng.normal(0, s, 60))] + [(None, "BUY")] for s in (0.3, 20.0, 4.0)]
    schema = "bps double, side string"
    q = SO.histogram_stream(streamed(spark, tmp_path, batches, schema), "bps", ["side"], f"{tmp_path}/h", f"{tmp_path}/cp")
    q.awaitTermination(180)
    got = SO.read_histogram(spark, f"{tmp_path}/h", ["side"])
    want = orders.histogram(spark.createDataFrame(sum(batches, []), schema), "bps", ["side"], 30)
    assert rows(got.withColumn("bin", F.round("bin", 9))) == rows(want.withColumn("bin", F.round("bin", 9)))
    assert got.select("bin").distinct().count() <= 31


def test_stack_fits_side_by_side(spark, monkeypatch):
    running, most = set(), [0]
    plain = learn._base

    def watched(columns, rounds):
        pipeline = plain(columns, rounds)
        fit = pipeline.fit

        def one(*args):
            running.add(id(pipeline))
            most[0] = max(most[0], len(running))
            try:
                return fit(*args)
            finally:
                running.discard(id(pipeline))

        pipeline.fit = one
        return pipeline

    monkeypatch.setattr(learn, "_base", watched)
    n = 80
    t = pd.DataFrame({"sig_id": range(n), "dt": [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)], "minervini": np.arange(n) % 7.0,
                      "hurst": np.arange(n) % 5.0, "vix": 18.0, "cred": 0.0, "term": 1.0, "market_pcr": 1.0})
    t["ret"] = np.where(np.arange(n) % 3 == 0, 0.05, -0.05)
    stack = learn.fit_stack(spark.createDataFrame(t), ["minervini", "hurst"], rounds=1)
    assert most[0] > 1 and set(stack.models) == {"meta", "p_a", "p_b"}
