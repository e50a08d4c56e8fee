"""Order events as a stream: per-batch tables whose fold equals the batch result of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from sigloom.operators.orders import TERMINAL, latest_state, nice_step, tca_rows


def state_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest state per order under ``path``.

    Each micro-batch appends its own per-order summaries under a batch folder, overwritten if the
    batch is retried; ``read_state`` folds them. Nothing is read back while writing.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        s = latest_state(batch)
        s.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_state(spark, path: str) -> DataFrame:
    """Fold of the micro-batch summaries: a first final state wins, else the newest."""
    s = spark.read.parquet(path)
    counts = s.groupBy("client_oid").agg(F.sum("n_events").alias("n"))
    return latest_state(s.drop("n_events", "batch_id"), "broker_seq").drop("n_events").join(
        counts, "client_oid").withColumnRenamed("n", "n_events")


def compact_state(spark, path: str, to: str) -> None:
    """The folded state as one summary in folder ``to``; a stream that starts anew there goes on from it."""
    read_state(spark, path).write.mode("overwrite").parquet(f"{to}/batch_id=-1")


def finals_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each order's first final event (FILLED or REJECTED), once: a micro-batch writes the orders that no earlier one
    has written. The batch folder is overwritten on a retry, so a retry writes the same rows."""
    def add(batch: DataFrame, batch_id: int) -> None:
        new = latest_state(batch.where(F.col("status").isin(*TERMINAL))).drop("broker_oid", "broker_seq", "n_events")
        try:
            done = batch.sparkSession.read.parquet(path).where(F.col("batch_id") < batch_id).select("client_oid")
            new = new.join(done, "client_oid", "left_anti")
        except AnalysisException:  # nothing is written yet
            pass
        new.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def streamed_tca(spark, path: str, orders: DataFrame) -> DataFrame:
    """Transaction-cost rows of the orders whose first final event is FILLED."""
    filled = spark.read.parquet(path).where("status = 'FILLED'")
    return tca_rows(filled.select("client_oid", F.col("price").alias("execution_price"), F.col("ts").alias("timestamp")), orders)


def first_finals(events: DataFrame, keep: str = "30 days") -> DataFrame:
    """Each order's first final event (FILLED or REJECTED), emitted once: keyed state instead of a look at all that was written.

    ``events`` (client_oid, seq, ts, status, price) is a stream. Of the final events of an order in one micro-batch the
    one with the lowest seq counts; later ones change nothing. The state is one flag an order and is dropped ``keep``
    after the order's event time, so that it does not grow for ever; an order's final events come closer together.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    finals = events.where(F.col("status").isin(*TERMINAL)).withWatermark("ts", keep)
    key = finals.schema["client_oid"].dataType.simpleString()

    def first(ids, parts, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        best = None
        for part in parts:  # one order's events of a micro-batch, in chunks
            row = part.loc[part["seq"].idxmin()]
            if best is None or row["seq"] < best["seq"]:
                best = row
        if best is not None and not state.exists:
            state.update((True,))
            state.setTimeoutTimestamp(max(int(best["ts"].timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
            yield pd.DataFrame({"client_oid": [ids[0]], "seq": [best["seq"]], "ts": [best["ts"]], "status": [best["status"]],
                                "price": [best["price"]]})

    return finals.select("client_oid", "seq", "ts", "status", "price").groupBy("client_oid").applyInPandasWithState(
        first, f"client_oid {key}, seq long, ts timestamp, status string, price double", "done boolean", "append",
        GroupStateTimeout.EventTimeTimeout)


def tca_stream(events: DataFrame, orders: DataFrame, keep: str = "30 days") -> DataFrame:
    """Transaction-cost rows of a stream of events, once an order: first final events that are fills, against the order table."""
    fills = first_finals(events, keep).where("status = 'FILLED'")
    return tca_rows(fills.select("client_oid", F.col("price").alias("execution_price"), F.col("ts").alias("timestamp")), orders)


def histogram_stream(rows: DataFrame, value: str, by: list[str], path: str, checkpoint: str, max_bins: int = 30) -> StreamingQuery:
    """Keep a histogram of ``value`` under ``path`` whose bins may widen as the range grows.

    A micro-batch is counted in bins of 10^k, the power of ten below the width that its own range would need; coarser
    widths (1, 2 or 5 times a power of ten) are made of whole such bins, so ``read_histogram`` can merge batches of any
    ranges. A retried batch overwrites its own folder.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        x = batch.where(F.col(value).isNotNull())
        span = x.agg((F.max(value) - F.min(value)).alias("_s"))  # one row
        k = F.floor(F.log10(F.greatest(F.col("_s"), F.lit(1e-9)) / max_bins)).cast("int")
        x = x.crossJoin(F.broadcast(span.select(k.alias("k"))))
        at = F.floor(F.col(value) / F.pow(F.lit(10.0), F.col("k"))).cast("long")
        x.groupBy("k", at.alias("at"), *by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).write.mode(
            "overwrite").parquet(f"{path}/batch_id={batch_id}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_histogram(spark, path: str, by: list[str], max_bins: int = 30) -> DataFrame:
    """bin (left edge), ``by``, n: what ``operators.orders.histogram`` gives for all rows of the batches together."""
    h = spark.read.parquet(path)
    step = h.agg((F.max("hi") - F.min("lo")).alias("s")).select(nice_step(F.col("s"), max_bins).alias("_step"))  # one row
    fold = F.round(F.col("_step") / F.pow(F.lit(10.0), F.col("k")))
    at = F.floor(F.col("at") / F.greatest(fold, F.lit(1.0)))
    return h.crossJoin(F.broadcast(step)).groupBy((at * F.col("_step")).alias("bin"), *by).agg(F.sum("n").alias("n"))


def slippage_histogram_stream(tca: DataFrame, step: float) -> DataFrame:
    """bin, side, n for complete-mode output; a stream needs a fixed step."""
    return tca.groupBy((F.floor(F.col("slippage_bps") / step) * step).alias("bin"), "side").agg(
        F.count(F.lit(1)).alias("n"))
