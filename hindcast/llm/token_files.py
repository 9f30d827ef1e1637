"""Token ids in ORC files: stripes with integer run-length encoding, row indexes and Bloom filters on document ids.

Layout: one ORC file per range of document ids, rows in ascending order (null id first, repeated ids by a hash of
their text).  Columns: file int, doc_id, start long (ids before the row in its file), n_tokens long, ids array<int>.
A reader can take single stripes in parallel; min/max and Bloom filters of the row groups skip what a look-up by
``doc_id`` doesn't need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import pieces, shuffle_partitions
from .tokens import Encoder

LAYOUT = "file int, doc_id long, start long, n_tokens long, ids array<int>"
WRITER = {
    "compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
    "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "orc.encoding.strategy": "SPEED",
}


def _encode_sorted(tokenizer: str, mode: str, end_id: int):
    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        file, before = TaskContext.get().partitionId(), 0
        for batch in pieces(batches, "text", 2 << 20):
            encoder = Encoder.of(tokenizer, mode)
            ids, width = encoder.encode(batch.column("text"))
            n = len(width)
            ends = np.cumsum(width)
            flat = np.insert(ids, ends, end_id).astype(np.int32)  # the end id after each document
            width = width + 1
            offsets = np.concatenate([[0], np.cumsum(width)])
            yield pa.record_batch({
                "file": pa.array(np.full(n, file, np.int32)), "doc_id": batch.column("doc_id"),
                "start": pa.array(before + offsets[:-1]), "n_tokens": pa.array(width),
                "ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)),
            })
            before += int(offsets[-1])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, mode: str = "spaced", end_id: int = 2, files: int | None = None, key: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text (null: empty), append ``end_id``, write in ascending order of the key.

    Documents are dealt out by range before they are encoded, so each task encodes, sorts and writes one file and a lost
    task is simply run again.  Texts travel, ids don't.  Empty table: no file but a valid folder.  Other columns are
    ignored.
    """
    files = files or shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    dealt = rows.repartitionByRange(files, "doc_id", F.xxhash64("text")).sortWithinPartitions(*order)
    dealt.mapInArrow(_encode_sorted(tokenizer, mode, end_id), LAYOUT).write.format("orc").options(**WRITER).save(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of the files with ``start`` counted over all files.  ``doc_ids`` are looked up through the indexes.

    The number of ids per file (one row per file) comes from the integer columns alone.
    """
    rows = spark.read.schema(LAYOUT).orc(path)
    per = rows.groupBy("file").agg(F.sum("n_tokens").alias("__n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin(doc_ids))
    return rows.join(base, "file").select("doc_id", (F.col("start") + F.col("__before")).alias("start"), "n_tokens", "ids")


def ids_crc32(batches) -> Iterator:
    """Replaces the ids by the crc32 of their little-endian 32-bit integers."""
    import zlib

    import pyarrow as pa

    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("ids"))
        offsets = ids.offsets.to_numpy()
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.record_batch([*[batch.column(i) for i, c in enumerate(batch.schema.names) if c != "ids"], pa.array(crc, pa.int64())], names=[*[c for c in batch.schema.names if c != "ids"], "ids_crc32"])
