"""Messages delivered more than once: exactly one copy of each stays.

A structured stream reads the deliveries. Its keyed state store holds, for each identifier seen, the best copy so far:
the earliest (ts, row). A state belongs to a stretch of event time and leaves when the watermark has passed
that stretch; the engine's aggregation expires states by event time only if that is part of their key. Every micro-batch
writes the states it changed to a folder named by its number, so a batch that is repeated after a failure replaces its
own output: offsets, state and output advance together.

With a folder of its own the stream stands: another run goes on from the checkpoint, reads only files that are new, and
appends to the states of the runs before. Without one a run starts afresh.

A copy that comes after its state has left is late, and the state store doesn't see it. Every run notes the number of
such rows and its watermark; if there ever were any, the copies older than the watermark are looked up in the source and
compete with the states that were written.

Scale: states lie in RocksDB on the executors' disks, with change logs in the checkpoint; copies are reduced by identifier before the shuffle, so an identifier with a
third of all rows moves one row per task. The rows to drop come from an anti-join on the row number, which
has no hot keys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ntz_micros, shared_dir

NEVER = 2**62
PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUNS = "late long, watermark string"
STATES = "k1 string, k2 string, best struct<us: long, row_no: long>"


def copies(rows: DataFrame, keys: tuple[str, str], ts: str, row: str) -> DataFrame:
    """(k1, k2, c, event_time): identified copies with c = (us, row_no), by which copies compare."""
    us = ntz_micros(ts)
    return rows.where(F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull()).select(
        F.col(keys[0]).cast("string").alias("k1"),
        F.col(keys[1]).cast("string").alias("k2"),
        F.struct(F.coalesce(us, F.lit(NEVER)).alias("us"), F.col(row).cast("long").alias("row_no")).alias("c"),
        # A copy without a time mustn't move the watermark; once there is one, it counts as late and is looked up.
        F.timestamp_micros(F.coalesce(us, F.lit(0))).alias("event_time"),
    )


def parquet_stream(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    """A stream over a parquet folder, or over a single parquet file (read as its folder with a filter on the name)."""
    schema = spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


def seen_states(stream: DataFrame, *, keys: tuple[str, str], ts: str, row: str, delay: str, retention: str) -> DataFrame:
    """The streaming aggregation: per identifier and stretch of event time the best copy so far."""
    c = copies(stream, keys, ts, row).withWatermark("event_time", delay)
    return c.groupBy("k1", "k2", F.window("event_time", retention)).agg(F.min("c").alias("best")).select("k1", "k2", "best")


def repeated_deliveries(spark: SparkSession, path: str, *, keys: tuple[str, str] = ("id", "group"), ts: str = "ts", row: str = "row_no", files_per_batch: int = 64, delay: str = "30 days", retention: str = "90 days", folder: str | None = None) -> DataFrame:
    """row_no of every copy to drop; the copy with the earliest ts stays, among equal ts the smallest row_no.

    Runs the stream over all that lies at path and that a run with the same folder hasn't read yet, until it is caught up. A row without an identifier (either key
    null) is no message that can be recognised again and always stays. A null ts counts as later than any
    other. An empty table gives an empty result; other columns are ignored. The row number is unique.
    """
    at = folder or shared_dir(spark, "delivery")
    changed = seen_states(parquet_stream(spark, path, files_per_batch), keys=keys, ts=ts, row=row, delay=delay, retention=retention)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/states/batch={number}")

    set_before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, set_before) if set_before else spark.conf.unset(PROVIDER)
    late, watermark = 0, None
    try:
        while not query.awaitTermination(1):
            pass
    finally:
        for p in query.recentProgress:
            late += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
            watermark = (p.eventTime or {}).get("watermark", watermark)
    # Counts that have scrolled away may have told of late copies.
    late += len(query.recentProgress) >= int(spark.conf.get("spark.sql.streaming.numRecentProgressUpdates"))
    if query.recentProgress:
        spark.createDataFrame([(late, watermark)], RUNS).write.parquet(f"{at}/runs/{uuid.uuid4().hex}")
    source = spark.read.parquet(path)
    every = copies(source, keys, ts, row)
    states = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/states")
    if not states.getFileSystem(spark._jsc.hadoopConfiguration()).exists(states):
        return every.where("false").select("c.row_no")
    best = spark.read.schema(STATES).parquet(f"{at}/states").select("k1", "k2", F.col("best").alias("c"))
    runs = spark.read.schema(RUNS).option("recursiveFileLookup", True).parquet(f"{at}/runs").agg(F.sum("late").alias("late"), F.max("watermark").alias("watermark")).first()
    if runs["late"]:
        old = every.where(F.col("event_time") < F.to_timestamp(F.lit(runs["watermark"]))) if runs["watermark"] else every
        best = best.unionByName(old.drop("event_time"))
    kept = best.groupBy("k1", "k2").agg(F.min("c").alias("c")).select(F.col("c.row_no").alias("row_no"))
    return every.select(F.col("c.row_no").alias("row_no")).join(kept, "row_no", "left_anti")
