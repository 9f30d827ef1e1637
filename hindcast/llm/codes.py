"""Vector code compression: vectors as short codes of codebook entries, found by Orchard search.

Vectors are cut into equal parts; each part position has a codebook of few entries, trained in rounds of assigning and
averaging.  All arithmetic is in whole numbers, so results do not depend on how the rows are dealt out.

* Orchard search: every entry keeps the list of all other entries, sorted by distance from it.  The search for a part
  walks the list of the best entry so far, skips marked entries, jumps to the list of an entry that is better, and stops
  where the list goes beyond twice the current distance: by the triangle inequality no entry there is nearer or as near.
* A round is one pass over the rows: a task adds up its parts by entry and hands on one row for each part and entry.
  The codebooks are the only thing the driver sees (parts x entries x length numbers, whatever the table holds).
* The codes of the first assignment are stored beside the vectors; later rounds start their walks there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import spread_join, stored
from .vectors import common_length, complete, matrix

#: Rows that a task handles at a time.
CHUNK = 10_000


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): int64 where that is safe in sums of squares, otherwise Python's integers."""
    with np.errstate(over="ignore"):
        c = np.floor(x * scale)
    most = min(float(np.abs(c).max(initial=0)), 2.0**31)
    if 32 * x.shape[-1] * most**2 < 2.0**62:
        return c.astype(np.int64)
    out = np.empty(x.shape, object)
    for i, v in enumerate(x.flat):  # a product beyond a double is that of a whole number
        out.flat[i] = int(c.flat[i]) if np.isfinite(c.flat[i]) else int(v) * scale
    return out


def _squares(diff: np.ndarray) -> np.ndarray:
    return (diff * diff).sum(axis=-1)


class Codebook:
    """Entries of one part position with the neighbour lists of Orchard search."""

    def __init__(self, entries: np.ndarray):
        k = len(entries)
        safe = entries.dtype == object and max((abs(int(v)) for v in entries.flat), default=0) ** 2 * 32 * entries.shape[1] < 2**62
        self.entries = entries.astype(np.int64) if safe else entries
        far = _squares(self.entries[:, None] - self.entries[None]) if k else np.zeros((0, 0), np.int64)
        self.lists = np.array([[e for e in np.argsort(far[i], kind="stable") if e != i] for i in range(k)], np.int64).reshape(k, max(k - 1, 0))
        self.gaps = np.take_along_axis(far, self.lists, 1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of x (the lower one of two) and its squared distance; walks begin at ``start``."""
        if x.dtype != self.entries.dtype:
            x, entries, gaps = x.astype(object), self.entries.astype(object), self.gaps.astype(object)
        else:
            entries, gaps = self.entries, self.gaps
        own = start.astype(np.int64)
        best = _squares(x - entries[own])
        marked = np.zeros((len(x), len(entries)), bool)
        marked[np.arange(len(x)), own] = True
        at = np.zeros(len(x), np.int64)
        live = np.arange(len(x)) if len(entries) > 1 else np.zeros(0, np.int64)
        while len(live):
            live = live[(gaps[own[live], at[live]] <= 4 * best[live]).astype(bool)]
            e = self.lists[own[live], at[live]]
            at[live] += 1
            new = ~marked[live, e]
            i, e = live[new], e[new]
            marked[i, e] = True
            d = _squares(x[i] - entries[e])
            better = ((d < best[i]) | ((d == best[i]) & (e < own[i]))).astype(bool)
            j = i[better]
            own[j], best[j], at[j] = e[better], d[better], 0
            live = live[at[live] < len(entries) - 1]
        return own, best


def _chunks(batches, scale: int, parts: int) -> Iterator:
    """(batch, vectors as whole numbers: rows x parts x length)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, CHUNK):
            part = batch.slice(lo, CHUNK)
            x = matrix(part.column("vector"))
            yield part, whole(x, scale).reshape(len(x), parts, -1)


def _codes(part, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, parts)


def _first(books: list[Codebook], scale: int):
    """Adds the codes of the first assignment."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        for part, x in _chunks(batches, scale, len(books)):
            start = np.zeros(len(x), np.int64)
            code = np.stack([b.nearest(x[:, p], start)[0] for p, b in enumerate(books)], axis=1).astype(np.uint8)
            yield pa.record_batch([*part.columns, pa.array([c.tobytes() for c in code], pa.binary())], names=[*part.schema.names, "code"])

    return run


def _sums(books: list[Codebook], scale: int):
    """One row for each part and entry: how many parts of the task it is nearest to, and their sums as decimal text."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        k, w = books[0].entries.shape
        count, total = np.zeros((len(books), k), np.int64), np.zeros((len(books), k, w), object)
        for part, x in _chunks(batches, scale, len(books)):
            start = _codes(part, len(books))
            for p, b in enumerate(books):
                own, _ = b.nearest(x[:, p], start[:, p])
                sums = np.zeros((k, w), x.dtype)
                np.add.at(sums, own, x[:, p])
                total[p] += sums.astype(object)
                count[p] += np.bincount(own, minlength=k)
        p, e = np.nonzero(count)
        yield pa.record_batch({"part": pa.array(p.astype(np.int32)), "entry": pa.array(e.astype(np.int32)), "n": pa.array(count[p, e]), "sums": pa.array([[str(v) for v in total[i, j]] for i, j in zip(p, e)], pa.list_(pa.string()))})

    return run


def _added(key, rows):
    import pandas as pd

    n = int(rows["n"].sum())
    total = [sum(int(v) for v in column) for column in zip(*rows["sums"])]
    return pd.DataFrame({"part": [key[0]], "entry": [key[1]], "means": [[str(t // n) for t in total]]})


def _final(books: list[Codebook], scale: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for part, x in _chunks(batches, scale, len(books)):
            start = _codes(part, len(books))
            found = [b.nearest(x[:, p], start[:, p]) for p, b in enumerate(books)]
            code = np.stack([own for own, _ in found], axis=1).astype(np.uint8)
            error = [sum(int(best[i]) for _, best in found) for i in range(len(x))]
            yield pa.record_batch([part.column("vec_id"), part.column("label"), pa.array([c.tobytes().hex() for c in code]), pa.array([e if e < 2**63 else None for e in error], pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def vector_codes(
    df: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
    key: str = "vec_id", vector: str = "embedding", label: str = "label", name: str = "vector-codes",
) -> DataFrame:
    """One row per kept row: vec_id, label, code (two hex digits for each part), error (squared distance), label_error (errors
    added up over equal labels, nulls together), codebooks_sha256 (of the entries' components as decimal text).

    Vectors that are null or hold a null or non-finite component are dropped, and so are empty ones and those of a length
    that ``parts`` does not divide or that is not the most frequent such length.  Zero vectors stay.  The codebooks start
    from the rows with the smallest ids; rows with one id are ordered by their vectors, null ids come last.  Repeated
    rows count as often as they are there.  Fewer rows than ``entries`` (at most 256): fewer entries.  Ties go to the
    lower entry.  An error beyond a long is null and counts for no label.  Empty table: no rows.
    """
    spark = df.sparkSession
    d = common_length(df, vector, parts)
    rows = df.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    rows = rows.filter(complete(F.col("vector")) & (F.size("vector") == F.lit(d or 0)))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    least = rows.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    if not least:
        return spark.createDataFrame([], f"{kinds}, code string, error long, label_error long, codebooks_sha256 string")
    start = whole(np.array([r["vector"] for r in least], np.float64), scale).reshape(len(least), parts, -1)
    books = [Codebook(start[:, p]) for p in range(parts)]
    rows = stored(rows.mapInArrow(_first(books, scale), f"{kinds}, vector {rows.schema['vector'].dataType.simpleString()}, code binary"), f"{name}-rows")
    for _ in range(rounds):
        sums = rows.select("vector", "code").mapInArrow(_sums(books, scale), "part int, entry int, n long, sums array<string>")
        means = sums.groupBy("part", "entry").applyInPandas(_added, "part int, entry int, means array<string>").collect()  # parts x entries
        new = np.stack([b.entries.astype(object) for b in books])
        for r in means:
            new[r["part"], r["entry"]] = [int(v) for v in r["means"]]
        books = [Codebook(e) for e in new]
    coded = stored(rows.select("vec_id", "label", "vector", "code").mapInArrow(_final(books, scale), f"{kinds}, code string, error long"), f"{name}-codes")
    totals = stored(coded.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.try_sum("error").alias("label_error")), f"{name}-labels")
    text = ",".join(str(int(v)) for b in books for v in b.entries.flat)
    return spread_join(coded, totals, ["label"], "n").withColumn("codebooks_sha256", F.lit(hashlib.sha256(text.encode()).hexdigest()))
