"""Isotonic regression as a table of blocks, pooled in parallel.

Pooling adjacent violators gives one result whatever the order of the pooling, so every task pools the stretch of scores it
holds, and only blocks go on: stretches are dealt out anew, with other borders, until no two neighbours violate the order.
No task and no driver holds a row for each score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.hot import cut_lineage
from .history import history, lag, past

#: Blocks of a stretch.
STRETCH = 200_000
BLOCKS = "lo double, hi double, total double, weight double"


def pool(lo: np.ndarray, hi: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Adjacent violators pooled, whole falling runs at a time, until the means rise."""
    while len(lo) > 1:
        mean = total / weight
        first = np.flatnonzero(np.concatenate([[True], mean[1:] > mean[:-1]]))
        if len(first) == len(lo):
            break
        last = np.append(first[1:], len(lo)) - 1
        lo, hi, total, weight = lo[first], hi[last], np.add.reduceat(total, first), np.add.reduceat(weight, first)
    return lo, hi, total, weight


def _pooled(batches) -> Iterator:
    """Blocks in the order of scores -> fewer blocks."""
    import pyarrow as pa

    held = tuple(np.zeros(0) for _ in range(4))
    for batch in batches:
        held = pool(*(np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("lo", "hi", "total", "weight"))))
    yield pa.record_batch([pa.array(h) for h in held], names=["lo", "hi", "total", "weight"])


def isotonic_blocks(df: DataFrame, p: str, y: str, weight: Column | None = None, stretch: int | None = None) -> DataFrame:
    """lo, hi, value, weight: the blocks of the non-decreasing least-squares fit of ``y`` to the score ``p``.

    Rows with a NULL or NaN score, a NULL result or no weight take no part; equal scores are one point."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(F.col(p).cast("double").alias("s"), F.col(y).cast("double").alias("y"), w.alias("w")).filter("s IS NOT NULL AND NOT isnan(s) AND y IS NOT NULL AND w > 0")
    blocks = rows.groupBy(F.col("s").alias("lo")).agg(F.sum(F.col("y") * F.col("w")).alias("total"), F.sum("w").alias("weight"))
    blocks = cut_lineage(blocks.select("lo", F.col("lo").alias("hi"), "total", "weight"))
    size, round_ = stretch or STRETCH, 0
    while True:
        n = blocks.count()
        parts = math.ceil(n / size) + round_ % 2 if n > size else 1  # another number of stretches has other borders
        dealt = blocks.repartitionByRange(parts, "lo") if parts > 1 else blocks.coalesce(1)
        blocks = cut_lineage(dealt.sortWithinPartitions("lo").mapInArrow(_pooled, BLOCKS))
        if parts == 1 or not _violated(blocks):
            return blocks.select("lo", "hi", (F.col("total") / F.col("weight")).alias("value"), "weight")
        round_ += 1


def _violated(blocks: DataFrame) -> bool:
    """Whether a block's mean is not above that of the block before it."""
    rows = blocks.withColumn("__all", F.lit(0)).withColumn("__m", F.col("total") / F.col("weight"))
    return not history(rows, "__all", "lo", __before=lag("__m")).filter(F.col("__m") <= F.col("__before")).isEmpty()


def isotonic_value(df: DataFrame, blocks: DataFrame, p: str, name: str) -> DataFrame:
    """``name``: the fit at score ``p``: a block's value inside it, linear between two blocks, the outer values beyond.

    Rows and blocks meet in the order of scores, like an as-of join; NULL and NaN scores have no value."""
    one = blocks.withColumn("__all", F.lit(0))
    nxt = history(one.withColumn("__back", -F.col("lo")), "__all", "__back", __lo=lag("lo"), __value=lag("value"))
    known = nxt.select(F.col("lo").alias("__p"), F.struct("lo", "hi", "value", F.col("__lo").alias("next"), F.col("__value").alias("after")).alias("__b"))
    first = blocks.agg(F.min_by("value", "lo").alias("__first"))  # scores below all blocks
    score = F.when(~F.isnan(F.col(p).cast("double")), F.col(p).cast("double"))
    rows = df.withColumn("__p", score).withColumn("__row", F.struct(*df.columns)).select("__p", "__row")
    kind = known.schema["__b"].dataType
    both = known.select("__p", F.lit(0).alias("__kind"), "__b", F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"))
    both = both.unionByName(rows.select("__p", F.lit(1).alias("__kind"), F.lit(None).cast(kind).alias("__b"), "__row")).withColumn("__all", F.lit(0))
    met = history(both.filter("__p IS NOT NULL"), "__all", ["__p", "__kind"], __of=past("last", "__b")).filter("__kind = 1")
    of = lambda c: F.col(f"__of.{c}")
    slope = of("value") + (of("after") - of("value")) * (F.col("__p") - of("hi")) / (of("next") - of("hi"))
    value = F.when((F.col("__p") <= of("hi")) | of("next").isNull(), of("value")).otherwise(slope)
    met = met.crossJoin(F.broadcast(first)).select("__row.*", F.coalesce(value, "__first").alias(name))  # one row
    void = rows.filter("__p IS NULL").select("__row.*", F.lit(None).cast("double").alias(name))
    return met.unionByName(void)
