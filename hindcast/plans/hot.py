"""Hot-key detection.

A window, a grouped map or a sort-merge join sends all rows of one key to one
task.  Operators that do so ask this module first which keys are too big and
then split exactly those keys; every other key keeps the single-shuffle plan.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Rows of one key that a single task may hold.
DEFAULT_HOT_ROWS = 5_000_000

HOT_ROWS_CONF = "spark.hindcast.hotRows"
BROADCAST_CONF = "spark.hindcast.broadcastBytes"
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def hot_row_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))


def input_bytes(df: DataFrame) -> float:
    """Bytes of the stored inputs under ``df`` (sum over the plan's leaves)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return float(sum(float(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())))


#: Stored bytes of a table whose rows one task sorts and joins, and the size from which that is asked for: Spark joins
#: small shuffle partitions up by their compressed bytes, which says little of what several sorts of a task hold.
TASK_BYTES = 2 * 1024 * 1024
DEAL_FROM = 16 * 1024 * 1024


def deal(df: DataFrame, *keys: str, factor: int = 1) -> DataFrame:
    """Deal the rows of a large frame by ``keys`` over a number of partitions that grows with its stored inputs, so that
    what a task holds does not.  The shuffle is the one that a join, window or aggregate by these keys needs anyway; small
    frames are left to Spark.  ``factor``: how many times more a task makes of its rows than it is given."""
    try:
        size = input_bytes(df)
    except Exception:  # no JVM plan at hand (Spark Connect)
        return df
    return df.repartition(factor * math.ceil(size / TASK_BYTES), *keys) if size * factor > DEAL_FROM else df


#: Shuffle files of a query go when it ends, not when the driver happens to collect what refers to them.
FREED_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark) -> Iterator[None]:
    """Queries that are run in here leave no shuffle files behind: for results that are kept elsewhere (a table, some
    numbers on the driver), so that the disk holds one step at a time."""
    before = spark.conf.get(FREED_CONF, None)
    spark.conf.set(FREED_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED_CONF) if before is None else spark.conf.set(FREED_CONF, before)


@dataclass(frozen=True)
class HotKeys:
    """The hot keys of one frame: at most (rows / limit) entries, by pigeonhole.

    ``table`` also has ``__class``: a key of class c has more than limit * 2^c rows,
    and at most twice as many."""

    keys: list[str]
    table: DataFrame
    biggest: int

    def classes(self) -> list[int]:
        return sorted(r["__class"] for r in self.table.select("__class").distinct().collect())


#: What was found per session, limit and key plan; the counts of a chain of blocks on
#: one stored table and key are taken once.
_FOUND: dict[tuple, HotKeys | None] = {}


def _key_plan(df: DataFrame, keys: list[str]) -> str | None:
    """The optimised plan of the key columns alone.  Columns that other operators have
    added are pruned from it, so it is the same all along a chain of blocks."""
    try:
        plan = df.select(*keys)._jdf.queryExecution().optimizedPlan().canonicalized()
        return f"{plan.hashCode()}:{plan.toString()}"
    except Exception:  # no JVM plan at hand (Spark Connect): count each time
        return None


def hot_keys(df: DataFrame, keys: list[str], limit: int | None = None) -> HotKeys | None:
    """Keys with more than ``limit`` rows, or None: one map-side-combined count over the
    key columns, whatever the size of the files.  Rows that a join or an explode below has
    multiplied are counted as they are.  A finding that is out of date (files replaced in
    the session) costs speed, never results: keys that are not in it are simply not split."""
    spark = df.sparkSession
    limit = limit or hot_row_limit(df)
    plan = _key_plan(df, keys)
    at = (spark.sparkContext.applicationId, spark._jsparkSession.sessionUUID() if plan else "", limit, tuple(keys), plan)
    if plan and at in _FOUND:
        return _FOUND[at]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit)
    counts = counts.withColumn("__class", F.floor(F.log2(F.col("__n") / limit)).cast("int"))
    with freed(spark):
        rows = counts.collect()  # <= rows/limit entries
    found = HotKeys(keys, spark.createDataFrame(rows, counts.schema), max(r["__n"] for r in rows)) if rows else None
    if plan:
        if len(_FOUND) > 10_000:
            _FOUND.clear()
        _FOUND[at] = found
    return found


def shared_folder(spark) -> str:
    """The folder all executors share, as the session names it.  Without a name only a session of one machine gets one
    of its own: what one machine of a cluster keeps to itself, the others miss."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="hindcast-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a frame that is read several times below: a table file in the shared
    folder, so it survives the loss of executors."""
    path = f"{shared_folder(df.sparkSession)}/hindcast-{uuid.uuid4().hex}"
    with freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def match(keys: list[str], left: str = "l", right: str = "r") -> Column:
    """Null-safe equality over ``keys`` between two aliased frames."""
    cond = None
    for k in keys:
        c = F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
        cond = c if cond is None else cond & c
    return cond


def tag_hot(df: DataFrame, hot: HotKeys, payload: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Split ``df`` into (cold rows, hot rows); hot rows also carry ``payload`` columns."""
    side = hot.table.select(*hot.keys) if payload is None else payload
    cold = df.alias("l").join(F.broadcast(hot.table.select(*hot.keys).alias("r")), match(hot.keys), "left_anti")
    extra = [c for c in side.columns if c not in hot.keys]
    hot_rows = (
        df.alias("l")
        .join(F.broadcast(side.alias("r")), match(hot.keys), "inner")
        .select(*[F.col(f"l.`{c}`") for c in df.columns], *[F.col(f"r.`{c}`") for c in extra])
    )
    return cold, hot_rows


def sized_broadcast(df: DataFrame) -> DataFrame:
    """Hint a broadcast when the stored inputs of ``df`` fit the limit, else leave
    the choice (shuffle join, AQE skew split) to Spark."""
    limit = float(df.sparkSession.conf.get(BROADCAST_CONF, str(DEFAULT_BROADCAST_BYTES)))
    try:
        small = input_bytes(df) <= limit
    except Exception:
        small = False
    return F.broadcast(df) if small else df


def salted_self_pairs(df: DataFrame, group: list[str], hot: HotKeys | None, spread: int = 64):
    """Left and right sides of a self-join on ``group`` with hot groups spread.

    The left rows of a hot group are dealt over ``spread`` salts and its right
    rows are copied to each of them, so the group's pairs are built by
    ``spread`` tasks.  Other groups get salt 0 on both sides.
    """
    if hot is None:
        return df, df, list(group)
    cold, heavy = tag_hot(df, hot)
    zero = F.lit(0).cast("int")
    deal = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(spread)).cast("int")
    left = cold.withColumn("__salt", zero).unionByName(heavy.withColumn("__salt", deal))
    every = F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).cast("int")
    right = cold.withColumn("__salt", zero).unionByName(
        heavy.select("*", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("__salt"))
    )
    return left, right, [*group, "__salt"]
