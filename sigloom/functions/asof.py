"""As-of join: each row of one time line meets the newest row of another that is not later than it.

Both lines are stacked, exchanged once on the key and sorted by time; the newest value is the last non-null one so far.
No range comparison and no pair of rows is formed, and the two sides may have any relative density.

Bound: a key's two lines together are one window partition. They are meant for bar tables (a row for each key and
period); raw ticks are brought to bars first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: Column, right_time: Column, values: dict[str, Column],
              tolerance: float | None = None, strict: bool = False, age: str | None = None) -> DataFrame:
    """``left`` with ``values`` of the newest row of ``right`` at or before ``left_time`` (before it, if ``strict``).

    ``tolerance`` is the greatest age in seconds; older matches count as none. ``age`` names a column for the age in
    seconds. Rows of ``left`` without a match, without a key or without a time keep nulls. Times of ``right`` are
    unique for each key; a row of it without a time is not used.
    """
    kept = F.struct(*values and [v.alias(k) for k, v in values.items()])
    r = right.where(right_time.isNotNull() & F.col(by).isNotNull()).select(
        F.col(by).alias("_k"), right_time.cast("timestamp").alias("_t"), F.lit(0 if not strict else 1).alias("_side"),
        F.struct(right_time.cast("timestamp").alias("at"), kept.alias("v")).alias("_r"))
    rows = left.select(F.col(by).alias("_k"), left_time.cast("timestamp").alias("_t"), F.lit(1 if not strict else 0).alias("_side"),
                       F.struct(*left.columns).alias("_l"))
    line = rows.unionByName(r, allowMissingColumns=True)
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    past = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    line = line.repartition(n, "_k").withColumn("_m", F.last("_r", ignorenulls=True).over(past)).where(F.col("_l").isNotNull())
    old = F.col("_t").cast("double") - F.col("_m.at").cast("double")
    fits = F.col("_k").isNotNull() & F.col("_t").isNotNull()
    if tolerance is not None:
        fits = fits & (old <= tolerance)
    out = {k: F.when(fits, F.col("_m.v")[k]).alias(k) for k in values}
    if age:
        out[age] = F.when(fits, old).alias(age)
    return line.select(*[F.col("_l")[c].alias(c) for c in left.columns if c not in out], *out.values())
