"""Ordered computations over groups of any size.

A window over a group puts the whole group in one task. Where a group is not bounded (all trades
in log order, one day's universe, one class of samples) these functions are used instead: the rows
are range-sorted on a unique key, so that hot groups split over many partitions, written once to
the checkpoint folder, and per-partition totals are carried forward. The carried table has one
row per partition (or per group straddling a partition edge), which is what gets broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigloom.session import broadcast_if_small, materialise

ROW_MASK = (1 << 33) - 1


def range_sorted(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` globally sorted and materialised, with ``_part`` and ``_pos`` (row in partition)."""
    s = df.orderBy(*order)
    s = s.withColumn("_part", F.spark_partition_id())
    s = s.withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_MASK)))
    return materialise(s)


def row_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """0-based global row number in ``order`` (a unique key), no single-task sort."""
    s = range_sorted(df, order)
    sizes = s.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition
    off = sizes.select(
        "_part",
        F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
    )
    return (
        s.join(broadcast_if_small(off), "_part")
        .withColumn(name, F.col("_off") + F.col("_pos"))
        .drop("_part", "_pos", "_off")
    )


def prefix_sum(df: DataFrame, order: list[Column], values: dict[str, Column],
               group: list[str] | None = None) -> DataFrame:
    """Running sums, current row included, in ``order`` (unique, starting with the group columns).

    ``values`` maps each output to a non-null input expression. With ``group`` the sums restart
    at each group; a group may span any number of partitions.
    """
    group = group or []
    s = range_sorted(df.withColumns({f"_v_{k}": v for k, v in values.items()}), order)
    inside = Window.partitionBy("_part", *group).orderBy("_pos").rowsBetween(
        Window.unboundedPreceding, 0)
    totals = s.groupBy("_part", *group).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    # A group has one row per partition it touches; only straddling groups carry anything.
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumns({f"_c_{k}": F.sum(f"_t_{k}").over(earlier) for k in values})
    first = f"_c_{next(iter(values))}"
    carry = carry.where(F.col(first).isNotNull()).select(
        "_part", *group, *[f"_c_{k}" for k in values])
    s = s.withColumns({k: F.sum(f"_v_{k}").over(inside) for k in values})
    s = s.join(broadcast_if_small(carry), ["_part", *group], "left")
    s = s.withColumns({k: F.col(k) + F.coalesce(F.col(f"_c_{k}"), F.lit(0)) for k in values})
    return s.drop("_part", "_pos", *[f"_v_{k}" for k in values], *[f"_c_{k}" for k in values])


def average_rank(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Tie-averaged rank of ``value`` within ``group`` for every row; a null has no rank.

    One path for all sizes: both windows use the sort by (group, value). It is meant for groups of
    one date, which hold a row for each symbol at most.
    """
    known = F.col(value).isNotNull()
    w = Window.partitionBy(*group).orderBy(F.asc_nulls_last(value))
    ties = Window.partitionBy(*group, value)
    return df.withColumn(name, F.when(known, F.rank().over(w) + (F.count("*").over(ties) - 1) / F.lit(2.0)))


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per group, for groups of any size.

    Equal values collapse to a count before the sort, so no task ever holds a group.
    """
    base = df.where(F.col(value).isNotNull())
    counts = base.groupBy(*group, value).agg(F.count("*").alias("_c"))
    run = prefix_sum(counts, [*[F.col(g) for g in group], F.col(value)],
                     {"_upto": F.col("_c")}, group)
    sizes = counts.groupBy(*group).agg(F.sum("_c").alias("_n"))
    run = run.join(broadcast_if_small(sizes), group) if group else run.crossJoin(sizes)
    picks = []
    for k, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (pos >= F.col("_upto") - F.col("_c")) & (pos < F.col("_upto"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{side}_{k}"))
    agg = run.groupBy(*group, "_n").agg(*picks)
    out = agg.select(*group, *[
        (F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}"))
         * ((F.col("_n") - 1) * F.lit(float(p)) - F.floor((F.col("_n") - 1) * F.lit(float(p))))
         ).alias(k)
        for k, p in probs.items()
    ])
    return out
