"""Readers and writers of the engine's own tables; schemas are explicit, bad JSON is kept aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.scalar import no_nan
from sigloom.session import materialise

BARS = ("sym string, freq string, dt timestamp, open double, high double, low double, close double, "
        "volume double")
PICK = ("symbol string, score int, ai_prob double, signals array<string>, factors array<string>, "
        "ml_features map<string,double>, ml_list array<double>, curr_close double, tp double, sl double, "
        "news string, sector string, pos_advice string")
PICK_LOG = (f"date string, vix double, macro_meta struct<vix:double, credit_spread_mom:double, "
            f"vix_term_structure:double, market_pcr:double>, top_picks string, shadow_pool string, "
            f"_corrupt_record string")
TCA = ("client_oid string, symbol string, side string, qty double, arrival_price double, "
       "execution_price double, timestamp timestamp, slippage_bps double, ai_prob double")
ORDERS = ("client_oid string, symbol string, side string, qty double, order_type string, "
          "limit_price double, arrival_price double, status string, filled_qty double, "
          "avg_fill_price double, retry_count int, broker_oid string, created_at timestamp, "
          "updated_at timestamp")
PROVIDER = "bars map<string, array<struct<t:string, o:double, h:double, l:double, c:double, v:double>>>"


def read_bars(spark: SparkSession, path: str, freq: str = "1d", symbols: DataFrame | None = None,
              since: Column | None = None) -> DataFrame:
    """Bars of one frequency: ``freq`` prunes partitions, ``since`` reaches the file statistics,
    ``symbols`` is a semi-join. NaN becomes null here, once."""
    df = spark.read.schema(BARS).parquet(path).where(F.col("freq") == freq)
    if since is not None:
        df = df.where(F.col("dt") >= since)
    if symbols is not None:
        df = df.join(symbols.select("sym").distinct(), "sym", "left_semi")
    return df.withColumns({c: no_nan(F.col(c)) for c in ("open", "high", "low", "close", "volume")})


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    bars.write.mode(mode).partitionBy("freq").parquet(path)


def write_bar_table(bars: DataFrame, name: str, path: str | None = None, buckets: int = 64) -> None:
    """Bars as a table bucketed and sorted by sym: reads by symbol, joins on it and windows over it need no exchange."""
    w = bars.write.mode("overwrite").bucketBy(buckets, "sym").sortBy("sym", "dt")
    (w.option("path", path) if path else w).saveAsTable(name)


def picked_bars(spark: SparkSession, name: str, picks: DataFrame) -> DataFrame:
    """Bars of the symbols of ``picks`` from a bucketed table: only the distinct symbols are exchanged, not the bars."""
    return spark.table(name).join(picks.select("sym").distinct(), "sym", "left_semi")


def write_pick_log(picks: DataFrame, path: str) -> None:
    """JSON lines, one a date, of picks (dt, symbol, score, ai_prob, signals, factors, and ml_features where there are any)."""
    item = [c for c in ("symbol", "score", "ai_prob", "signals", "factors", "ml_features") if c in picks.columns]
    lines = picks.groupBy("dt").agg(F.collect_list(F.struct(*item)).alias("top_picks"))
    lines.select(F.to_json(F.struct(F.col("dt").cast("string").alias("date"), "top_picks")).alias("value")).write.mode("overwrite").text(path)


def flatten_provider_json(raw: DataFrame, column: str = "json") -> DataFrame:
    """{"bars": {sym: [{t,o,h,l,c,v}]}} payloads to bar rows."""
    j = raw.select(F.from_json(column, PROVIDER).alias("j")).select(F.explode("j.bars").alias("sym", "b"))
    return j.select("sym", F.inline("b")).select(
        F.regexp_replace("sym", r"[\^/]", "_").alias("sym"), F.to_timestamp("t").alias("dt"),
        F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"),
        F.col("c").alias("close"), F.col("v").alias("volume"))


def read_pick_logs(spark: SparkSession, pattern: str) -> DataFrame:
    """JSON lines of picks with ``log_id`` in (file, position) order; malformed lines are dropped.

    A pick's features may be a map or a positional list, which one schema cannot hold, so the
    picks are read as text and parsed both ways.
    """
    raw = spark.read.schema(PICK_LOG).option("mode", "PERMISSIVE").json(pattern)
    raw = raw.select("*", F.col("_metadata.file_name").alias("_f"),
                     F.col("_metadata.file_block_start").alias("_o"))
    # a line's id orders first by file, then by split, then by row within the split
    ok = raw.withColumn("_row", F.monotonically_increasing_id()).where("_corrupt_record IS NULL AND date IS NOT NULL")
    item = f"array<struct<{_fields(PICK, 'ml_list')}>>"
    lists = "array<struct<ml_features array<double>>>"

    def picks(c: str) -> Column:
        return F.zip_with(F.from_json(c, item), F.from_json(c, lists), lambda a, b: F.when(
            a.isNotNull(), a.withField("ml_list", b["ml_features"])))

    return ok.select(F.struct("_f", "_o", "_row").alias("log_id"), "date", "vix", "macro_meta",
                     picks("top_picks").alias("top_picks"), picks("shadow_pool").alias("shadow_pool"))


def _fields(ddl: str, drop: str) -> str:
    """The struct fields of a DDL string without one of them."""
    import re
    parts = re.split(r",\s(?![^<]*>)", ddl)
    return ", ".join(p for p in parts if not p.startswith(drop))


def read_tca(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TCA).json(path)


def append_tca(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def append_samples(samples: DataFrame, path: str, batch_date: str) -> None:
    """Add training samples under their batch date; a retried batch replaces only itself."""
    samples.withColumn("batch_date", F.lit(batch_date)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("batch_date").parquet(path)


def upsert(rows: DataFrame, path: str, keys: list[str], order: list[str], buckets: int = 64) -> None:
    """Merge ``rows`` into the table at ``path``: of each key the row that is largest by ``order`` stays.

    The table is dealt into hash buckets of the keys, and only buckets that ``rows`` touch are read, merged and swapped
    (a dynamic partition overwrite). Merging the same rows again changes nothing, so a retry is safe. Rows with a null
    key are kept under that key. The bucket count is fixed when the table is made.
    """
    spark = rows.sparkSession
    new = materialise(rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # ``buckets`` at most
    if not touched:
        return
    if _exists(spark, path):
        new = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched)).unionByName(new)
    rest = [c for c in rows.columns if c not in keys]
    newest = new.groupBy("bucket", *keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v"))
    merged = materialise(newest.select(*keys, *[F.col("_v")[c].alias(c) for c in rest], "bucket"))
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    """One row a key of a table that ``upsert`` keeps."""
    return spark.read.parquet(path).drop("bucket")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def publish_report(tables: dict[str, DataFrame], path: str, version: int) -> None:
    """Write several tables that belong together as one ``version``, and name it in the manifest last.

    A reader sees the version that the newest manifest names, whole, whatever is being written beside it. Publishing a
    version again replaces it.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/data/{version}/{name}")
    row = [(version, sorted(tables))]
    spark.createDataFrame(row, "version long, tables array<string>").drop("version").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/manifest/version={version}")


def read_report(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a published version, the newest by default."""
    m = spark.read.parquet(f"{path}/manifest")
    if version is not None:
        m = m.where(F.col("version") == version)
    last = m.orderBy(F.desc("version")).first()
    if last is None:
        raise LookupError(f"no version {version or ''} at {path}")
    return {name: spark.read.parquet(f"{path}/data/{last['version']}/{name}") for name in last["tables"]}


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def append_orders(orders: DataFrame, path: str) -> None:
    """Pending orders; ids repeat on a retry, so readers keep one row per id."""
    orders.write.mode("append").parquet(path)
