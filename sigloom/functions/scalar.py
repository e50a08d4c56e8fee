"""Column helpers: guarded division, clamps and null scrubbing, all inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def clip(x: Column, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(hi))), F.lit(float(lo))))


def safe_div(num: Column, den: Column, cap: float = 20.0) -> Column:
    """num/den clamped to +/-cap; a null operand or a zero denominator gives 0."""
    return F.coalesce(clip(F.try_divide(num, den), -cap, cap), F.lit(0.0))


def scrub(x: Column, cap: float) -> Column:
    """Null and NaN to 0, infinities to +/-cap."""
    inf = float("inf")
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(0.0))
        .when(x == F.lit(inf), F.lit(float(cap)))
        .when(x == F.lit(-inf), F.lit(-float(cap)))
        .otherwise(x)
    )


def no_nan(x: Column) -> Column:
    """NaN to null: the library knows one missing value only."""
    return F.when(~F.isnan(x), x)


def yes(cond: Column) -> Column:
    """A comparison with a null side is false."""
    return F.coalesce(cond, F.lit(False))


def trunc_int(x: Column) -> Column:
    return x.cast("int")


def crosses_above(prev_fast: Column, prev_slow: Column, fast: Column, slow: Column) -> Column:
    """Fast line was strictly below the slow one and is now strictly above."""
    return yes((prev_fast < prev_slow) & (fast > slow))


def slippage_bps(exec_price: Column, arrival: Column, side: Column) -> Column:
    sign = F.when(side == "SELL", F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.abs(exec_price - arrival) / (arrival + F.lit(EPS)) * F.lit(10000.0) * sign
