"""Mixing sources to target weights by entropy balancing, in DataFrame expressions throughout.

The document rates r minimise ``sum r (ln r - 1)`` under ``0 <= r <= cap`` and, for each source, ``sum r * size =
target``. The dual is convex with one variable a source, and its solution is the tilted rate ``r = min(cap,
exp(lam * size / mean_size))``. Newton steps on the dual run over a (source, size) histogram, which partial sums
shrink before the shuffle, so the hot source costs no more than any other. Rates then become whole copies: the whole
part, plus one more for the documents whose keyed hash lies lowest below the fractional part, cut where the source's
words come nearest to its target.

Defined cases: a null or empty text has size 0 and is taken ``cap`` times or less at no cost; null sources form one
source, last in order; sources without a word have target 0. Repeated rows of one text and doc_id are numbered, each
has a hash of its own, and so some of them get the extra copy. An empty table gives an empty mix. Columns that the plan adds replace input columns of their names; ``mixed`` returns
the input columns untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigloom.functions.scan import prefix_sum
from sigloom.llm.common import saved
from sigloom.session import broadcast_if_small

BINS = 4096
STEPS = 60
CLOSE = 1e-9
PLAN = ["size", "source_size", "target", "rate", "copies", "taken"]


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def source_targets(hist: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Targets of all sources: weights repeat over the ordered sources, ``cap`` times a source's size is never passed.

    Resharing the excess by weight ends at ``min(cap * size, weight * level)``; the level is found by going through the
    sources from the smallest ``cap * size / weight`` up. One row for each source.
    """
    totals = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    t = saved(totals.withColumn("weight", weight).withColumn("most", cap * F.col("source_size")))
    up = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    t = t.withColumn("level", level).withColumn("at", F.row_number().over(up))
    holds = F.col("level") <= F.col("most") / F.col("weight") * (1 + 1e-12)
    first = F.min(F.when(holds, F.struct("at", "level"))).over(every)["level"]
    return t.withColumn("target", F.least("most", F.col("weight") * first)).select(
        "source", "source_size", "docs", "most", "target")


def balanced(hist: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """``targets`` with ``lam``: Newton on the logarithm of the dual's gradient, kept inside a shrinking bracket."""
    state = saved(targets.withColumns({
        "lam": F.lit(0.0), "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"),
        "open": (F.col("target") > 0) & (F.col("target") < F.col("most") * (1 - CLOSE))}))
    for _ in range(STEPS):
        if state.where("open").isEmpty():
            break
        s = state.where("open").select(F.col("source").alias("s"), "lam", (F.col("docs") / F.col("source_size")).alias("per"))
        x = F.col("size") * F.col("per")
        tilt = F.exp(F.least(F.col("lam") * x, F.lit(700.0)))
        words = F.col("n") * F.col("size")
        got = hist.where("size > 0").join(broadcast_if_small(s), F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(
            F.sum(words * F.least(F.lit(cap), tilt)).alias("f"),
            F.sum(F.when(tilt < cap, words * x * tilt).otherwise(0.0)).alias("g"))
        j = state.join(broadcast_if_small(got), F.col("source").eqNullSafe(F.col("s")), "left")
        lo = F.when(F.col("f") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("f") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        step = F.when(F.col("g") > 0, F.log(F.col("f") / F.col("target")) * F.col("f") / F.col("g")).otherwise(
            F.when(F.col("f") > F.col("target"), F.lit(1e9)).otherwise(F.lit(-1e9)))
        far = F.greatest(F.lit(4.0), 2 * F.abs("lam"))
        newton = F.col("lam") - F.greatest(-far, F.least(far, step))
        inside = (lo.isNull() | (newton > lo)) & (hi.isNull() | (newton < hi))
        j = j.select("source", "source_size", "docs", "most", "target", "open", "lam", "f", lo.alias("lo"), hi.alias("hi"),
                     F.when(inside, newton).otherwise((lo + hi) / 2).alias("next"))
        done = F.abs(F.col("f") / F.col("target") - 1) < CLOSE
        state = saved(j.select("source", "source_size", "docs", "most", "target",
                               F.when(F.col("open") & ~done, F.col("next")).otherwise(F.col("lam")).alias("lam"),
                               "lo", "hi", (F.col("open") & ~done).alias("open")))
    return state.withColumn("lam", F.round("lam", 9))


def _rated(sized: DataFrame, params: DataFrame, cap: float) -> DataFrame:
    """``sized`` (source, size, u) with its source's parameters, the rate, and the bin of the extra copy."""
    p = params.withColumnRenamed("source", "_s")
    j = sized.join(broadcast_if_small(p), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    x = F.col("size") * F.col("docs") / F.col("source_size")
    rate = F.when(F.col("target") >= F.col("most") * (1 - CLOSE), F.lit(cap)).when(F.col("target") <= 0, F.lit(0.0)).otherwise(
        F.least(F.lit(cap), F.exp(F.least(F.col("lam") * x, F.lit(700.0)))))
    j = j.withColumn("rate", F.round(rate, 9)).withColumn("whole", F.floor("rate"))
    part = F.col("rate") - F.col("whole")
    extra = (part > 0) & (F.col("whole") + 1 <= cap) & (F.col("size") > 0)
    return j.withColumn("bin", F.when(extra, F.floor((F.col("_u") - part + 1) * (BINS / 2)).cast("int")))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_u``, a fixed number from 0 to 1 by ``_k``; rows that share a ``_k`` are numbered and have one each."""
    again = saved(rows.groupBy("_k").agg(F.count("*").alias("_c")).where("_c > 1").select("_k"))
    unit = lambda x: F.shiftrightunsigned(x, 11) / F.lit(float(1 << 53))
    if again.isEmpty():
        return rows.withColumn("_u", unit(F.col("_k"))).drop("_k")
    again = broadcast_if_small(again)
    several = rows.join(again, "_k", "left_semi").withColumn("_at", F.monotonically_increasing_id())
    several = prefix_sum(several, [F.col("_k"), F.col("_at")], {"_j": F.lit(1).cast("long")}, ["_k"])
    several = several.withColumn("_u", unit(F.xxhash64("_k", "_j"))).drop("_k", "_at", "_j")
    return rows.join(again, "_k", "left_anti").withColumn("_u", unit(F.col("_k"))).drop("_k").unionByName(several)


def plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 7) -> DataFrame:
    """``docs`` with size, source_size, target, rate, copies and taken (the words it gives, repeats counted)."""
    rest = [c for c in docs.columns if c not in PLAN]
    sized = _numbered(docs.select(F.struct(*rest).alias("_row"), "source", word_count(F.col("text")).alias("size"),
                                  F.xxhash64(F.lit(seed), "doc_id", "text").alias("_k")))
    slim = saved(sized.select("source", "size", "_u"))
    hist = saved(slim.groupBy("source", "size").agg(F.count("*").alias("n")))
    params = balanced(hist, source_targets(hist, weights, cap), cap)
    rated = _rated(slim, params, cap)
    # how many words each bin of extra copies would add; at most BINS rows a source
    bins = rated.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.sum(F.col("whole") * F.col("size")).alias("base"),
                                              F.first("target").alias("target"))
    run = Window.partitionBy("source").orderBy(F.asc_nulls_first("bin"))
    whole = F.sum("base").over(Window.partitionBy("source"))
    reach = F.sum(F.when(F.col("bin").isNotNull(), F.col("words")).otherwise(0)).over(run)
    cuts = bins.withColumn("off", F.abs(F.col("target") - whole - reach)).withColumn(
        "off0", F.abs(F.col("target") - whole))
    cut = cuts.groupBy("source").agg(F.min(F.struct("off", F.coalesce("bin", F.lit(-1)).alias("bin"))).alias("c"),
                                     F.first("off0").alias("off0"))
    cut = cut.select(F.col("source").alias("_c"),
                     F.when(F.col("off0") <= F.col("c.off"), F.lit(-1)).otherwise(F.col("c.bin")).alias("last"))
    params = saved(params.join(cut, F.col("source").eqNullSafe(F.col("_c")), "left").drop("_c"))
    out = _rated(sized, params, cap)
    copies = (F.col("whole") + F.coalesce((F.col("bin") <= F.col("last")).cast("int"), F.lit(0))).cast("int")
    return out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select("_row.*", *PLAN)


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 7) -> DataFrame:
    """The mix itself: each document as often as the plan says, columns as they are."""
    named = docs.select(F.struct(*docs.columns).alias("_d"), "doc_id", "text", "source")
    taken = plan(named, weights, cap, seed).where("copies > 0")
    return taken.select("_d", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("_d.*")
