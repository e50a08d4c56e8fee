"""Triggers to a 0-100 score, and the daily cross-section: cut, crowding, rank, shadow pool.

Per-day and per-sector statistics are partial aggregations joined back; the only ranks taken are
top-k ones, which Spark limits inside every map task before the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigloom.functions.scalar import trunc_int, yes
from sigloom.operators.triggers import fired, weighted_rules, with_points
from sigloom.params import POSITIVE_THEMES, THEMES, Params
from sigloom.session import broadcast_if_small


def theme_scores(p: Params = Params()) -> dict[str, Column]:
    """Per-theme points: plain ones added, each sub-theme pooled as its largest + 0.3 x the rest
    (= 0.7 max + 0.3 sum). SHORT is kept for the report; it never enters the score."""
    live = weighted_rules(p)
    out = {}
    for theme in THEMES:
        x = F.lit(0.0)
        for name, r in live:
            if r.theme == theme and r.sub is None:
                x = x + F.coalesce(F.col(name), F.lit(0.0))
        for sub in {r.sub for _, r in live if r.theme == theme and r.sub}:
            names = [n for n, r in live if r.theme == theme and r.sub == sub]
            total = F.lit(0.0)
            for n in names:
                total = total + F.coalesce(F.col(n), F.lit(0.0))
            top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
            x = x + F.coalesce(0.7 * top + 0.3 * total, F.lit(0.0))
        if theme == "TREND" and p.dedupe_cross:
            both = [n for n, r in live if r.tag in ("macd_cross", "cross_x_volume")]
            if len(both) == 2:
                cut = min(p.weights.get("macd_cross", 1.0) * 8,
                          p.weights.get("cross_x_volume", 1.0) * 12) * 0.5
                x = x - F.when(F.col(both[0]).isNotNull() & F.col(both[1]).isNotNull(),
                               float(cut)).otherwise(0.0)
        out[f"s_{theme.lower()}"] = x
    return out


def score_panel(panel: DataFrame, p: Params = Params(), keep: tuple[str, ...] | None = None) -> DataFrame:
    """Soft clip, saturation per theme and overall, veto, overbought filter -> int ``score``.

    ``keep`` names the panel columns to carry along (default: all).
    """
    kept = list(keep) if keep is not None else panel.columns
    need = list(dict.fromkeys([*kept, "pcr", "iv_skew", "is_credit_risk_high", "RSI"]))
    df = with_points(panel, p, tuple(need))
    df = df.select(*need, "notes", fired(p, "tag").alias("factors"), fired(p, "text").alias("_texts"),
                   *[c.alias(k) for k, c in theme_scores(p).items()])
    trend = F.col("s_trend")
    clipped = F.when(trend > 40, 40 + F.log1p(trend - 40) * 10).otherwise(trend)
    parts = F.lit(0.0)
    for t in POSITIVE_THEMES:
        s = clipped if t == "TREND" else F.col(f"s_{t.lower()}")
        parts = parts + F.when(s > 0, 50.0 * (1 - F.exp(-s / 25.0))).otherwise(0.0)
    veto = (yes(F.col("pcr") > p.pcr_bear) | yes(F.col("iv_skew") > p.skew_bear)
            | yes(F.col("is_credit_risk_high")))
    raw = 100.0 * (1 - F.exp(-parts / 50.0)) * F.when(veto, 0.1).otherwise(1.0)
    hot = yes(F.col("RSI") > 85.0)
    base = trunc_int(raw)
    texts = F.concat(F.col("_texts"), F.col("notes"))
    return df.select(
        *kept, *[f"s_{t.lower()}" for t in THEMES], "factors", veto.alias("veto"),
        F.when(hot, F.greatest(base - 30, F.lit(0))).otherwise(base).alias("score"),
        F.when(hot, F.array_append(texts, F.lit("[Warning] extremely overbought"))).otherwise(
            texts).alias("signals"))


def fallback_probability(score: Column) -> Column:
    return 0.45 + score / 100.0 * 0.2


def embedding_confidence(vector: Column) -> Column:
    """0.5 + 0.4 tanh(|v|/4); 0.5 without a vector."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.coalesce(0.5 + 0.4 * F.tanh(norm / 4.0), F.lit(0.5))


def position_levels(df: DataFrame) -> DataFrame:
    """tp, sl, adj_prob of each row. A missing ATR is 2% of the close; a missing or zero
    trailing stop falls back to the hard one."""
    c = F.col("close")
    atr = F.coalesce(F.col("ATR"), c * 0.02)
    hard = c - atr * 2.0
    trail = F.when(F.coalesce(F.col("Chandelier_Exit"), F.lit(0.0)) == 0.0, hard).otherwise(
        F.col("Chandelier_Exit"))
    return df.withColumns({
        "tp": c + atr * 3.5, "sl": F.greatest(hard, trail),
        "adj_prob": F.col("ai_prob") + F.when(yes(c > F.col("SMA_200")), 0.03).otherwise(0.0),
    })


def earnings_flag(rows: DataFrame, earnings: DataFrame, days: int = 5) -> DataFrame:
    """Add ``earnings_soon``: an announcement within 0..days of dt.

    Announcements are spread over the days they matter for, so the join is an equality on
    (sym, dt) rather than a date-range comparison.
    """
    near = earnings.select("sym", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(days)), lambda k: F.date_sub("dt", k))).alias("dt")).distinct()
    near = near.withColumn("earnings_soon", F.lit(True))
    return rows.join(near, ["sym", "dt"], "left").withColumn(
        "earnings_soon", F.coalesce("earnings_soon", F.lit(False)))


def with_sector(rows: DataFrame, sectors: DataFrame, p: Params = Params()) -> DataFrame:
    """First matching sector of each symbol, or the default bucket."""
    dim = sectors.groupBy("sym").agg(F.min("sector").alias("sector"))
    return rows.join(broadcast_if_small(dim), "sym", "left").withColumn(
        "sector", F.coalesce("sector", F.lit(p.default_sector)))


def eligible(rows: DataFrame) -> Column:
    return (F.col("score") > 0) & (F.col("adj_prob") > 0)


def halve_before_earnings(rows: DataFrame) -> DataFrame:
    """Adds raw_score (before halving), halves ``score`` and appends a warning."""
    soon = F.col("earnings_soon") & eligible(rows)
    out = rows.withColumn("raw_score", F.col("score")).withColumn(
        "score", F.when(soon, trunc_int(F.col("score") * 0.5)).otherwise(F.col("score")))
    if "signals" in rows.columns:
        out = out.withColumn("signals", F.when(soon, F.array_append(
            "signals", F.lit("[Warning] earnings within five days"))).otherwise(F.col("signals")))
    return out


def day_cut(rows: DataFrame, p: Params = Params(), score: str = "raw_score") -> DataFrame:
    """dt, cut: 85th percentile of the day's positive scores, at least the minimum.

    Scores are whole numbers 0..100, so at most 101 counted values per day reach the percentile.
    """
    counts = rows.where(F.col(score) > 0).groupBy("dt", score).agg(F.count("*").alias("_n"))
    return counts.groupBy("dt").agg(F.greatest(
        F.lit(float(p.min_score)), F.percentile(F.col(score), F.lit(0.85), F.col("_n"))).alias("cut"))


def apply_cut(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """Rows at or above their day's cut. Needs raw_score, score, adj_prob."""
    cut = broadcast_if_small(day_cut(rows, p))
    return rows.where(eligible(rows) | (F.col("raw_score") > 0) & (F.col("adj_prob") > 0)).join(
        cut, "dt").where(F.col("score") >= F.col("cut"))


def crowd(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """Within a day's sector of two or more, all but the best score are cut back.

    The best row and the size come from an aggregation per (dt, sector), so that one crowded
    sector does not become one task. ``health`` is the day's market health.
    """
    best = rows.groupBy("dt", "sector").agg(
        F.count("*").alias("_size"),
        F.min_by("sym", F.struct((-F.col("score")).alias("a"), F.col("sym").alias("b"))).alias("_best"))
    pen = F.greatest(F.lit(0.6), F.least(F.lit(0.9), p.crowding_penalty * (1.0 + F.col("health") * 0.3)))
    hit = ((F.col("_size") >= p.crowding_min) & ~F.col("sector").isin(*p.crowding_exempt)
           & (F.col("sym") != F.col("_best")))
    return rows.join(best, ["dt", "sector"]).withColumn(
        "score", F.when(hit, trunc_int(F.col("score") * pen)).otherwise(F.col("score"))
    ).drop("_size", "_best")


def kelly_weight(prob: Column, b: float = 1.5) -> Column:
    k = (prob * (b + 1) - 1) / b
    return F.greatest(F.lit(0.02), F.least(F.lit(0.12), k * 0.2))


def top_picks(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """Best rows of each day by 100 x probability + score; the rank is a limited top-k."""
    order = Window.partitionBy("dt").orderBy(
        F.desc(F.col("adj_prob") * 100.0 + F.col("score")), F.asc("sym"))
    return rows.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= p.top_n).withColumn("opt_weight", kelly_weight(F.col("adj_prob")))


def shadow_pool(rows: DataFrame, finals: DataFrame, p: Params = Params(), seed: str = "s") -> DataFrame:
    """Rows that fail score > 0 and probability > 0, minus the picks, in hash order per day."""
    pool = rows.where(~((F.col("raw_score") > 0) & (F.col("adj_prob") > 0))).join(
        finals.select("dt", "sym"), ["dt", "sym"], "left_anti")
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("sym").cast("string"), F.col("dt").cast("string")))
    order = Window.partitionBy("dt").orderBy(key, F.col("sym"))
    return pool.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= p.shadow_n)


def size_orders(picks: DataFrame, p: Params = Params()) -> DataFrame:
    """Pending limit orders; the id is a hash of (sym, dt), so a retry writes the same one."""
    qty = F.round(p.portfolio_value * F.col("exposure") * F.col("opt_weight")
                  / F.greatest(F.col("close"), F.lit(1e-10)), 4)
    key = F.md5(F.concat_ws("|", F.col("sym").cast("string"), F.col("dt").cast("string")))
    return picks.where("opt_weight > 0").select(
        F.concat(F.lit("Q_"), F.substring(key, 1, 8)).alias("client_oid"),
        F.col("sym").alias("symbol"), "dt", F.lit("BUY").alias("side"), qty.alias("qty"),
        F.lit("LMT").alias("order_type"), F.round(F.col("close") * 1.002, 2).alias("limit_price"),
        F.col("close").alias("arrival_price"), F.lit("PENDING_SUBMIT").alias("status"),
    ).where("qty > 0")


def report(picks: DataFrame) -> DataFrame:
    """One formatted block per pick, best first within the day."""
    icon = F.when(F.col("rank") == 1, "1st").when(F.col("rank") == 2, "2nd").when(
        F.col("rank") == 3, "3rd").otherwise("-")
    head = F.format_string(
        "%s %s | win rate %.1f%% | score %d", icon, F.col("sym").cast("string"),
        F.col("adj_prob") * 100, F.col("score"))
    levels = F.format_string(
        "price %.2f | target %.2f | stop %.2f | weight %.1f%%", F.col("close"), F.col("tp"),
        F.col("sl"), F.col("opt_weight") * 100)
    lines = F.concat_ws("\n", head, F.array_join(F.slice("signals", 1, 8), "\n"), levels)
    return picks.select("dt", "rank", "sym", lines.alias("block"))


def to_html(text: Column) -> Column:
    """Escape, then headings, bold and code marks to tags."""
    t = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, r"(?m)^### (.*?)$", "<b>$1</b>")
    t = F.regexp_replace(t, r"\*\*(.*?)\*\*", "<b>$1</b>")
    return F.regexp_replace(t, r"`(.*?)`", "<code>$1</code>")
