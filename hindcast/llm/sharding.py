"""Sharding by rendezvous hashing of a stable record key over weighted shards.

Every (key, shard) pair has one fixed random number u; the record goes to the shard with the smallest -ln(u) / weight.
A shard's share is its weight over the sum of weights, and a new shard can only win records for itself: no record moves
between two old shards.  The decision needs the key and the weights alone, no table and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import running_total

#: Sub-buckets of a shard while its rows are numbered; a shard of 3e10 / 24 rows has 300 000 rows in each.
SLOT_BUCKETS = 4096


def rendezvous(keys: list[Column], weights: list[float]) -> Column:
    """Shard number of a record.  Null keys count as a key of their own; equal keys share a shard."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be above zero")
    live = [(i, w) for i, w in enumerate(weights) if w > 0]
    nulls = [k.isNull() for k in keys]
    draws = []
    for i, w in live:
        u = (F.shiftrightunsigned(F.xxhash64(*keys, *nulls, F.lit(i)), 11).cast("double") + 0.5) / float(2**53)
        draws.append(F.struct((-F.ln(u) / F.lit(float(w))).alias("cost"), F.lit(i).alias("shard")))
    return F.array_min(F.array(*draws))["shard"] if len(draws) > 1 else F.lit(live[0][0])


def shard(
    docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text", grown: list[float] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: its key, size (UTF-8 bytes and 8), crc32 of the text, shard and slot.

    ``slot`` numbers the rows of a shard from 0 without a gap, in the order of a hash of the key.  ``grown`` are the
    weights after a change; the shard then goes to ``grown_shard``.
    Null text: 8 bytes, crc32 of nothing (0).  Null key: one key like any other.  Repeated rows: same shard, slots of
    their own.  Empty table: no rows.  Other columns are ignored.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(data).cast("long") + 8).alias("size"), F.crc32(data).alias("text_crc32"),
    )
    rows = rows.select(
        "*", rendezvous([F.col("doc_id")], weights).alias("shard"),
        (rendezvous([F.col("doc_id")], grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.xxhash64("doc_id", F.lit("slot")).alias("__h"),
    )
    bucket = F.shiftrightunsigned(F.col("__h"), 64 - SLOT_BUCKETS.bit_length() + 1).cast("int")
    order = [F.shiftrightunsigned(F.col("__h"), 1), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return running_total(rows, ["shard"], bucket, order, F.lit(1).cast("long"), "__n", "slot").drop("__n", "__h")
