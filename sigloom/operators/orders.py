"""Order rows, their status events, and transaction-cost rows and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.scalar import slippage_bps

TERMINAL = ("FILLED", "REJECTED")


def latest_state(events: DataFrame, broker_seq: str = "seq") -> DataFrame:
    """One row per order from append-only events.

    FILLED and REJECTED are final (nothing polls such an order again), so the first of them wins;
    otherwise the newest event counts. A broker id once known is kept, the newest by ``broker_seq``.
    All by aggregation: an order with very many events collapses map-side.
    """
    s = F.struct("status", "price", "ts", "seq")
    final = F.when(F.col("status").isin(*TERMINAL), F.col("seq"))
    known = F.when(F.col("broker_oid").isNotNull(), F.col(broker_seq))
    return events.groupBy("client_oid").agg(
        F.coalesce(F.min_by(s, final), F.max_by(s, "seq")).alias("s"),
        F.max_by("broker_oid", known).alias("broker_oid"), F.max(known).alias("broker_seq"),
        F.count(F.lit(1)).alias("n_events"),
    ).select("client_oid", "s.status", "s.price", "s.ts", "s.seq", "broker_oid", "broker_seq", "n_events")


def with_status(states: DataFrame, statuses: list[str]) -> DataFrame:
    return states.where(F.col("status").isin(*statuses))


def first_fills(events: DataFrame) -> DataFrame:
    """client_oid, execution_price, timestamp of orders whose final state is FILLED."""
    return latest_state(events).where("status = 'FILLED'").select(
        "client_oid", F.col("price").alias("execution_price"), F.col("ts").alias("timestamp"))


def tca_rows(fills: DataFrame, orders: DataFrame) -> DataFrame:
    """Slippage of each fill against its order's arrival price."""
    o = orders.select("client_oid", "symbol", "side", "qty", "arrival_price")
    return fills.join(o, "client_oid").select(
        "client_oid", "symbol", "side", "qty", "arrival_price", "execution_price", "timestamp",
        slippage_bps(F.col("execution_price"), F.col("arrival_price"), F.col("side")).alias("slippage_bps"))


def nice_step(span: Column, max_bins: int) -> Column:
    """Smallest 1, 2 or 5 x 10^k that needs at most ``max_bins`` bins."""
    raw = F.greatest(span, F.lit(1e-9)) / max_bins
    unit = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    m = raw / unit
    return unit * F.when(m <= 1, 1.0).when(m <= 2, 2.0).when(m <= 5, 5.0).otherwise(10.0)


def histogram(rows: DataFrame, value: str, by: list[str], max_bins: int) -> DataFrame:
    """bin (left edge), ``by``, n."""
    x = rows.where(F.col(value).isNotNull())
    step = x.agg((F.max(value) - F.min(value)).alias("s")).select(
        nice_step(F.col("s"), max_bins).alias("_step"))  # one row
    b = F.floor(F.col(value) / F.col("_step")) * F.col("_step")
    return x.crossJoin(F.broadcast(step)).groupBy(b.alias("bin"), *by).agg(F.count(F.lit(1)).alias("n"))


def latest_fills(tca: DataFrame, n: int = 25) -> DataFrame:
    return tca.orderBy(F.desc("timestamp"), "client_oid").limit(n)


def upsert_alerts(old: DataFrame, new: DataFrame) -> DataFrame:
    """(namespace, sym, ts, payload): newest per key of both tables."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.groupBy("namespace", "sym").agg(
        F.max("ts").alias("ts"), F.max_by("payload", "ts").alias("payload"))
