"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans.hot import freed, match, shared_folder as named_folder

#: What counts as white space between words, in Java, Python and DuckDB patterns alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder the cluster names; a local one only where none is named (tests)."""
    return f"{named_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table of the shared folder and read again: cuts the lineage,
    survives the loss of executors, and is computed once however often it is read."""
    path = shared_folder(df.sparkSession, name)
    with freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def uniform(seed: str, *keys: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the keys alone (52 bits of an md5, the same in SQL)."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def running_total(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], amount: Column, name: str, name_before: str = "") -> DataFrame:
    """Adds the running sum of ``amount`` inside each key, in the order of (bucket, order).

    ``bucket`` is a monotone prefix of the order with many values per key.  The sums of the buckets are added up first
    (one row per key and bucket), rows are sorted inside their bucket only; so a key with a third of all rows is
    spread over as many tasks as it has buckets.  Both sides of the join share one partitioning.  No key is null.
    """
    df = df.withColumn("__bucket", bucket).withColumn("__amount", amount)
    of_bucket = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        df.groupBy(*keys, "__bucket").agg(F.sum("__amount").alias("__total"))
        .select(*keys, "__bucket", F.coalesce(F.sum("__total").over(of_bucket), F.lit(0)).alias("__base"))
    )
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__run", F.sum("__amount").over(inside))
    out = rows.join(base, [*keys, "__bucket"]).withColumn(name, F.col("__run") + F.col("__base"))
    if name_before:
        out = out.withColumn(name_before, F.col(name) - F.col("__amount"))
    return out.drop("__bucket", "__amount", "__run", "__base")


#: A key with more than one in so many rows is hot: there can't be more of them than this.
HOT_PART = 2000


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], often: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``side``, which has one row for each value of ``keys`` (nulls equal) and, in the column
    ``often``, the number of ``rows`` that have it.  Both are stored tables.

    Keys with more than a HOT_PART-th of all rows, at most HOT_PART of them, are broadcast; the others meet in a shuffle
    in which no key is large.
    """
    total = rows.count()
    hot = F.col(often) * HOT_PART > total
    extra = [c for c in side.columns if c not in (*keys, often)]
    same = match(keys)

    def joined(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
        both = left.alias("l").join(right.alias("r"), same, kind)
        return both.select(*[F.col(f"l.{c}") for c in rows.columns], *[F.col(f"r.{c}") for c in extra])

    few, many = side.filter(hot).select(*keys, *extra), side.filter(~hot).select(*keys, *extra)
    cold = rows.alias("l").join(F.broadcast(few.select(*keys).alias("r")), same, "left_anti")
    return joined(rows, F.broadcast(few), "inner").unionByName(joined(cold, many, how))


# --- text as bytes, in numpy -----------------------------------------------------------------------------------------


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array and the n + 1 offsets of its rows; null rows are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    body = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if column.null_count:  # a null row may still cover bytes
        width = np.diff(offsets)
        live = ~np.asarray(column.is_null().to_numpy(zero_copy_only=False), dtype=bool)
        if (width[~live] > 0).any():
            body = np.concatenate([body[offsets[i] : offsets[i + 1]] for i in np.flatnonzero(live)] or [body[:0]])
        offsets = np.concatenate([[0], np.cumsum(np.where(live, width, 0))])
    return body, offsets


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    if seed:
        h += np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(33)
    return h


def slices(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start .. start + length - 1 of all slices, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def give_back():
    """Gives what a worker has freed back to the system: workers outlive their tasks, and what they hold is an executor's."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(batches, column: str, most: int = 8 << 20):
    """Cuts Arrow batches so that each holds about ``most`` bytes of text: a document stays whole, however long."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        width = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        part = (np.cumsum(width) - width) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a)
    give_back()


def runs(batches, names: list[str]):
    """Tables of the rows with equal values (no nulls) in the columns ``names``, of Arrow batches sorted by them."""
    import pyarrow as pa

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for c in names:
            v = batch.column(batch.schema.get_field_index(c)).to_numpy()
            new[1:] |= v[1:] != v[:-1]
            new[0] |= bool(held) and held[-1].column(held[-1].schema.get_field_index(c))[-1].as_py() != v[0]
        cuts = np.flatnonzero(new)
        at = 0
        for cut in cuts:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)
