"""Anchor / positive / negative triplets and their loss as a metric over existing vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.scan import row_index
from sigloom.session import broadcast_if_small, materialise

TEMPERATURE = 0.1


def hash_int(*parts: Column) -> Column:
    """32 bits of md5 as a number: the same draw on every engine and on every retry."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10
                  ).cast("long")


def return_class(ret: Column, threshold: float = 0.02) -> Column:
    return F.when(ret > threshold, 1).when(ret < -threshold, -1).otherwise(0)


def triplets(samples: DataFrame, noise: float = 0.02, seed: str = "t") -> DataFrame:
    """samples(id, vec, cls) -> id, cls, neg_id, anchor, positive, negative.

    Rows are numbered with the positive class first and the negative next, in hash order within a class, so that a
    draw from a class is a number in a range and the sampled join is an equality on it. The n-th anchor of a class
    draws the n-th row of its opposite class, starting over at its end: no row is drawn more than its share. Neutral
    anchors draw from both classes; an empty class stands for all rows.

    Each class is joined by itself. One of few rows is broadcast, however many anchors draw from it; one of many rows
    has few anchors a row.
    """
    rank = F.when(F.col("cls") == 1, 0).when(F.col("cls") == -1, 1).otherwise(2)
    ix = row_index(samples.withColumns({"_r": rank, "_h": hash_int(F.lit(seed), F.col("id"))}),
                   [F.col("_r"), F.col("_h"), F.col("id")], "slot")
    n = ix.agg(F.sum((F.col("cls") == 1).cast("long")).alias("_np"),
               F.sum((F.col("cls") == -1).cast("long")).alias("_nn"),
               F.count(F.lit(1)).alias("_n"))  # one row
    a = ix.crossJoin(F.broadcast(n))
    np_, nn, c = F.col("_np"), F.col("_nn"), F.col("cls")
    own = F.col("slot") - F.when(c == 1, 0).when(c == -1, np_).otherwise(np_ + nn)
    lo = F.when((c == 1) & (nn > 0), np_).otherwise(0)
    size = (F.when((c == 1) & (nn > 0), nn).when((c == -1) & (np_ > 0), np_)
            .when((c == 0) & (np_ > 0) & (nn > 0), np_ + nn).otherwise(F.col("_n")))
    draw = lo + F.pmod(own, size)
    part = F.when(draw < np_, 1).when(draw < np_ + nn, -1).otherwise(0)
    a = materialise(a.select("id", "cls", F.col("vec").alias("anchor"), draw.alias("slot"), part.alias("_part")))
    t = None
    for k in (1, -1, 0):
        drawn = ix.where((F.col("cls") == k) if k else ~F.col("cls").isin(1, -1))
        drawn = broadcast_if_small(drawn.select("slot", F.col("id").alias("neg_id"), F.col("vec").alias("negative")))
        met = a.where(F.col("_part") == k).drop("_part").join(drawn, "slot")
        t = met if t is None else t.unionByName(met)
    if noise > 0:
        def gauss(x: Column, k: Column) -> Column:
            u = [(hash_int(F.lit(f"{seed}{j}"), F.col("id"), k) + 1) / F.lit(4294967297.0) for j in (1, 2)]
            return x + noise * F.sqrt(-2.0 * F.log(u[0])) * F.cos(u[1] * 2.0 * F.pi())
        pos = F.transform("anchor", gauss)
    else:
        pos = F.col("anchor")
    return t.select("id", "cls", "neg_id", "anchor", pos.alias("positive"), "negative")


def _dot(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0),
                       lambda s, v: s + v)


def cosine(x: str, y: str, eps: float = 1e-8) -> Column:
    return _dot(x, y) / F.greatest(F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y)), F.lit(eps))


def triplet_loss(t: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """Add pos_sim, neg_sim and loss = log(1 + exp(neg - pos)) of the scaled cosines."""
    t = t.withColumns({"pos_sim": cosine("anchor", "positive") / temperature,
                       "neg_sim": cosine("anchor", "negative") / temperature})
    return t.withColumn("loss", F.log1p(F.exp(F.col("neg_sim") - F.col("pos_sim"))))
