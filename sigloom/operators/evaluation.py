"""Rank IC of factors against forward returns, its summary, and the factor selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigloom.functions.scalar import EPS
from sigloom.functions.scan import average_rank
from sigloom.params import Params


def rank_ic(long: DataFrame, min_rows: int = 5) -> DataFrame:
    """dt, factor, ic from (dt, factor, value, ret): Spearman correlation with averaged ties.

    Dates with fewer than five rows or (almost) constant returns are skipped; a constant factor
    has IC 0. Rows without a value or a return do not count.
    """
    long = long.where(F.col("value").isNotNull() & F.col("ret").isNotNull())
    days = long.groupBy("dt", "factor").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop("ret").alias("sd"), F.stddev_pop("value").alias("sf"))
    days = days.where((F.col("n") >= min_rows) & (F.col("sd") >= 1e-6))
    kept = long.select("dt", "factor", "value", "ret").join(days.drop("n", "sd"), ["dt", "factor"])
    r = average_rank(kept, ["dt", "factor"], "value", "rf")
    r = average_rank(r, ["dt", "factor"], "ret", "rr")
    spread = F.stddev_pop("rf") * F.stddev_pop("rr")
    ic = F.coalesce(F.try_divide(F.covar_pop("rf", "rr"), spread), F.lit(0.0))
    return r.groupBy("dt", "factor").agg(
        F.when(F.max("sf") >= 1e-6, ic).otherwise(0.0).alias("ic"))


def _ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, the mean of their places for equal values."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.concatenate([first, [len(s)]]))
    out = np.empty(len(x))
    out[order] = np.repeat(first + (size + 1) / 2.0, size)
    return out


def rank_ic_wide(rows: DataFrame, names: tuple[str, ...], min_rows: int = 5, digits: int | None = None, block: int = 8) -> DataFrame:
    """``rank_ic`` of the columns ``names`` of (dt, ret, ...), values rounded to ``digits`` first.

    A date's values of ``block`` factors are one Arrow group: a row for each symbol, ``block`` + 1 numbers each.
    """
    blocks = [names[k:k + block] for k in range(0, len(names), block)]
    parts = F.array(*[F.struct(F.lit(k).alias("part"), F.array(*[F.col(x).cast("double") for x in part]).alias("x"))
                      for k, part in enumerate(blocks)])
    dealt = rows.where(F.col("ret").isNotNull()).select("dt", F.col("ret").cast("double").alias("ret"), F.explode(parts).alias("p"))
    dealt = dealt.select("dt", "ret", "p.part", "p.x")

    def run(table: pa.Table) -> pa.Table:
        part = blocks[table.column("part")[0].as_py()]
        ret = table.column("ret").to_numpy()
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ret), -1)
        full, found = None, []
        for name, y in zip(part, x.T):
            have = ~np.isnan(y)
            if digits is not None:
                y = np.trunc(y * 10.0 ** digits + np.copysign(0.5, y)) / 10.0 ** digits
            r, y = ret[have], y[have]
            if len(y) < min_rows or r.std() < 1e-6:
                continue
            if len(y) == len(ret):
                full = rr = _ranks(r) if full is None else full
            else:
                rr = _ranks(r)
            rf = _ranks(y)
            spread = rf.std() * rr.std()
            ic = ((rf - rf.mean()) * (rr - rr.mean())).mean() / spread if y.std() >= 1e-6 and spread > 0 else 0.0
            found.append((name, ic))
        return pa.table({"dt": pa.array([table.column("dt")[0].as_py()] * len(found), pa.date32()),
                         "factor": pa.array([f for f, _ in found], pa.string()), "ic": pa.array([v for _, v in found], pa.float64())})

    return dealt.groupBy("dt", "part").applyInArrow(run, "dt date, factor string, ic double")


def ic_summary(ic: DataFrame, min_days: int = 5) -> DataFrame:
    """factor, mean_ic, ir, t_stat; all 0 with ``min_days`` dates or fewer."""
    n, m, s = F.count(F.lit(1)), F.avg("ic"), F.stddev_pop("ic") + EPS
    ok = n > min_days
    return ic.groupBy("factor").agg(
        n.alias("n_days"), F.when(ok, m).otherwise(0.0).alias("mean_ic"),
        F.when(ok, m / s).otherwise(0.0).alias("ir"),
        F.when(ok, m / (s / F.sqrt(n))).otherwise(0.0).alias("t_stat"))


def select_factors(summary: DataFrame, p: Params = Params(), at_least: int = 5) -> DataFrame:
    """Factors with |t| above the limit, best first; the top five when fewer than five pass.
    At most 64 rows, so an unpartitioned window is fine."""
    order = Window.orderBy(F.desc(F.abs("t_stat")), "factor")
    s = summary.withColumns({
        "rank": F.row_number().over(order), "active": F.abs("t_stat") > p.min_t_stat})
    n = F.sum(F.col("active").cast("long")).over(Window.partitionBy())
    s = s.withColumn("_n", n)
    return s.where((F.col("active") & (F.col("_n") >= at_least))
                   | ((F.col("_n") < at_least) & (F.col("rank") <= at_least))).drop("_n")


def weights(importances: DataFrame, n_factors: int) -> dict[str, float]:
    """``weight_map`` as the ``weights`` of ``Params`` (64 entries at most), for the score and the scenarios."""
    return {r["factor"]: r["weight"] for r in weight_map(importances, n_factors).collect()}


def top_factors(summary: DataFrame, n: int = 10) -> DataFrame:
    return summary.orderBy(F.desc(F.abs("t_stat")), "factor").limit(n)


def weight_map(importances: DataFrame, n_factors: int) -> DataFrame:
    """factor, weight from (factor, importance): 0 under a quarter of the equal share, otherwise
    the ratio to it clamped to 0.5..3."""
    share = 1.0 / n_factors
    x = F.col("importance")
    return importances.select("factor", F.when(x < share * 0.25, 0.0).otherwise(
        F.greatest(F.lit(0.5), F.least(F.lit(3.0), x / share))).alias("weight"))


def with_forward_return(factors: DataFrame, returns: DataFrame, horizon: int = 3) -> DataFrame:
    """(dt, factor, value, ret) by equality on (sym, dt)."""
    r = returns.where(F.col("horizon") == horizon).select("sym", "dt", "ret")
    return factors.join(r, ["sym", "dt"])


__all__ = ["ic_summary", "rank_ic", "rank_ic_wide", "select_factors", "top_factors", "weight_map", "weights", "with_forward_return"]
