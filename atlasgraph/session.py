"""Session helpers: table access, the shared folder, tz-free time arithmetic."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders this process asked for.
_WRITTEN: list[str] = []


def get_session(app: str = "atlasgraph", **conf: str) -> SparkSession:
    """A session with the settings the engine expects; keeps whatever the caller's session already has."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below spark.checkpoint.dir, the folder all executors share.

    Only where the setting is absent and the master runs in this very machine (tests) a
    temporary folder is used instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "atlasgraph-shared")
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append(path)
    return path


def cleanup(spark: SparkSession) -> int:
    """Delete what this process has put into the shared folder; call it when no result is needed any more. Returns how many
    folders were there."""
    gone = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


#: Whether Spark drops a query's shuffle files as soon as the query has ended.
_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, purpose: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors. The shuffle files of
    the write go with it, as no later plan reads them; else they stay until the driver collects its garbage."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    before = spark.conf.get(_FILE_CLEANUP, "false")
    spark.conf.set(_FILE_CLEANUP, "true")
    try:
        w.parquet(path)
    finally:
        spark.conf.set(_FILE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads, such as a loop's last round; others are left alone."""
    for df in tables:
        at = df.__dict__.pop("stored_at", None)
        if at:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
            _WRITTEN.remove(at)


def ntz_micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session's time zone (null stays null)."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("timestamp_ntz")
    day = F.unix_date(c.cast("date")).cast("long")
    sec = F.hour(c).cast("long") * 3600 + F.minute(c).cast("long") * 60
    frac = (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return (day * 86_400 + sec) * 1_000_000 + frac
