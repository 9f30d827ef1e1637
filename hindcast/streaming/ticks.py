"""Tick streams: ingest, latest values, deadline snapshots, repeats.  Keyed state is in ``keyed``."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.hot import shared_folder

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

TICK_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder for checkpoints and sinks, under the one the cluster shares."""
    return f"{shared_folder(spark)}/hindcast-{name}-{uuid.uuid4().hex}"


def tick_stream(spark: SparkSession, path: str, glob: str = "*.parquet", schema: str = TICK_SCHEMA, per_trigger: int | None = None) -> DataFrame:
    """File source with a declared schema; event time as a timestamp."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's setting comes back."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def run_to_table(stream: DataFrame, name: str, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run the stream over what is available and return what it wrote.

    Every micro-batch is written as files of its own (tagged ``batch``); a batch
    that is retried after a failure overwrites its own folder, so the sink is
    idempotent.  State is kept in RocksDB, on disk and in changelogs, so that a task's
    memory doesn't bound the number of keys and state may have timers.
    """
    spark = stream.sparkSession
    out, chk = work_path(spark, name), checkpoint or work_path(spark, f"{name}-chk")

    def write(batch: DataFrame, batch_id: int) -> None:
        df = each(batch, batch_id) if each else batch
        df.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", chk).trigger(availableNow=True).foreachBatch(write)
    with rocksdb(spark):
        q = writer.start()
    q.awaitTermination()
    schema = stream.schema if each is None else None
    reader = spark.read.option("basePath", out)
    if schema is not None:
        reader = reader.schema(schema.add("batch", "long"))
    return reader.parquet(f"{out}/batch=*")


def newest_per_key(written: DataFrame, keys: list[str]) -> DataFrame:
    """Result table of an update-mode stream: the last batch's row of every key."""
    cols = [c for c in written.columns if c not in keys and c != "batch"]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("r")).select(*keys, "r.*")


def latest_values(ticks: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Latest tick per key (update mode); ties on time go to the larger event id."""
    best = F.max_by(F.struct("ts", *columns), F.struct("ts", "event_id")).alias("r")
    return ticks.groupBy(*keys).agg(best).select(*keys, "r.*")


def deadline_snapshots(ticks: DataFrame, groups: DataFrame, group: str, start: str, minutes: int, columns: list[str], late: str = "7 days") -> DataFrame:
    """Latest tick up to ``minutes`` before the start, per group (update mode).

    The deadline predicate rejects later ticks whenever they arrive.  One row of state per
    group, whichever days its ticks fall on; it is dropped when starts of ``late`` after
    its own have been seen.
    """
    joined = ticks.join(groups, group).filter(F.col("ts") <= F.col(start) - F.expr(f"interval {minutes} minutes"))
    best = F.max_by(F.struct(F.col("ts").alias("snap_ts"), *columns), F.struct("ts", "event_id")).alias("r")
    return joined.withWatermark(start, late).groupBy(group, start).agg(best).select(group, start, "r.*")


def distinct_ticks(ticks: DataFrame, keys: list[str], within: str = "1 day") -> DataFrame:
    """Repeated ticks dropped as long as the repeat arrives inside the watermark."""
    return ticks.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)
