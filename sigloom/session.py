"""Session helpers: reliable lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it has been counted at or below this many rows.
MAX_BROADCAST_ROWS = 200_000
# The JVM interprets a method of more bytes for good (HotSpot's DontCompileHugeMethods).
COMPILED_BYTES = 8000


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and for bench.py; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sigloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; a temporary folder only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(path)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder, so several readers see the same rows
    and a lost executor does not recompute them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def compiled_steps(df: DataFrame) -> DataFrame:
    """``df``; its session gives up fusing steps whose common method would be too long to be compiled from now on.

    Wide projections (64 factors, 52 rules) fused into one loop pass that length; each by itself is cut into short methods.
    The setting is read when a plan runs, which may be after an operator has returned, so it stays.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(df.sparkSession.conf.get(key)) > COMPILED_BYTES:
        df.sparkSession.conf.set(key, str(COMPILED_BYTES))
    return df


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Materialise and count ``df``; hint a broadcast only below ``max_rows``.

    Beyond the limit the frame is returned unhinted and the join is a shuffled one.
    """
    out = materialise(df)
    return F.broadcast(out) if out.count() <= max_rows else out
