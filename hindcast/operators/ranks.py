"""Order statistics of growing prefixes, for many keys at once.

The k-th smallest of everything before a row is found offline: a wavelet matrix over the value ranks answers all rows of a
task together, a few array operations for each bit of the ranks, however long the history of a row is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..plans.hot import HotKeys, cut_lineage, tag_hot

FIRST = Window.unboundedPreceding
#: Rows that a task works on at a time; complete keys, so more where a key has more.
CHUNK = 200_000


class PrefixRanks:
    """k-th smallest of stretches of a sequence of whole numbers below ``size``."""

    def __init__(self, codes: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.zeros = []
        for bit in range(self.bits - 1, -1, -1):
            low = (codes >> bit) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(low)]))
            codes = np.concatenate([codes[low], codes[~low]])

    def kth(self, start: np.ndarray, end: np.ndarray, k: np.ndarray, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query the k-th smallest (from 0) of codes[start:end] and its place among equal ones.  ``base`` counts
        further members of every code, which belong to all stretches."""
        upto = np.zeros((1 << self.bits) + 1, np.int64)
        if base is not None:
            upto[1 : len(base) + 1] = np.cumsum(base)
            upto[len(base) + 1 :] = upto[len(base)]
        code, k = np.zeros(len(k), np.int64), k.astype(np.int64)
        for level, zeros in enumerate(self.zeros):
            half = 1 << (self.bits - 1 - level)
            a, b = zeros[start], zeros[end]
            count = b - a + upto[code + half] - upto[code]
            left = k < count
            k = np.where(left, k, k - count)
            start, end = np.where(left, a, zeros[-1] + start - a), np.where(left, b, zeros[-1] + end - b)
            code = np.where(left, code, code + half)
        return code, k


def _between(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Linear interpolation at rank ``at`` between the values of the ranks around it."""
    below = np.floor(at)
    return np.where(at == below, low, (below + 1 - at) * low + (at - below) * high)


def _changes(table, keys: list[str]) -> np.ndarray:
    """Whether each row has another key than the row before it; nulls are equal."""
    import pyarrow.compute as pc

    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        column = table.column(k).combine_chunks()
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        void = column.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= differ | (void[1:] != void[:-1])
    return new


def _expanding(keys: list[str], q: float, min_n: int):
    """Rows sorted by key and order, with the value in ``__v`` -> the same rows with the quantile in its place."""
    def answer(table):
        import pyarrow as pa

        v = table.column("__v").to_numpy(zero_copy_only=False).astype(np.float64)
        known = ~np.asarray(table.column("__v").is_null())
        before = np.concatenate([[0], np.cumsum(known)])[:-1]  # known values of all keys so far
        first = np.flatnonzero(_changes(table, keys))
        start = np.repeat(before[first], np.diff(np.append(first, len(v))))
        n = before - start
        values, code = np.unique(v[known], return_inverse=True)
        ask = np.flatnonzero(n >= max(1, min_n))
        out = np.full(len(v), np.nan)
        if len(ask):
            ranks = PrefixRanks(code, len(values))
            at = (n[ask] - 1) * q
            low, high = (values[ranks.kth(start[ask], before[ask], f(at))[0]] for f in (np.floor, np.ceil))
            out[ask] = _between(low, high, at)
        mask = np.ones(len(v), bool)
        mask[ask] = False
        return table.set_column(table.schema.get_field_index("__v"), "__v", pa.array(out, mask=mask))

    def run(batches) -> Iterator:
        import pyarrow as pa

        held = None
        for batch in batches:
            own = pa.Table.from_batches([batch])
            held = own if held is None else pa.concat_tables([held, own])
            if held.num_rows >= CHUNK:
                last = int(np.flatnonzero(_changes(held, keys))[-1])
                if last:
                    yield from answer(held.slice(0, last)).to_batches()
                    held = held.slice(last)
        if held is not None and held.num_rows:
            yield from answer(held).to_batches()

    return run


def expanding(df: DataFrame, keys: list[str], order: list, q: float, min_n: int) -> DataFrame:
    """``__v`` replaced by the quantile of the earlier values of the key; no key is larger than a task may hold."""
    schema = df.schema
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return rows.mapInArrow(_expanding(keys, q, min_n), schema)


# --- keys too large for one task --------------------------------------------------------------------------------------


def _places(q: float, min_n: int):
    """A time segment of a key, and how many earlier rows fall in each value bucket -> bucket and rank there."""
    def run(key, left, right):
        import pyarrow as pa

        pos, n = (left.column(c).to_numpy() for c in ("__pos", "__n"))
        by = np.argsort(pos, kind="stable")
        pos, n = pos[by], n[by]
        bucket = left.column("__b").combine_chunks()
        known = ~bucket.is_null().to_numpy(zero_copy_only=False)[by]
        codes = bucket.fill_null(0).to_numpy(zero_copy_only=False)[by][known].astype(np.int64)
        base = np.array(right.column("base")[0].as_py() if right.num_rows else [0], np.int64)
        ranks = PrefixRanks(codes, len(base))
        before = np.concatenate([[0], np.cumsum(known)])[:-1]
        ask = np.flatnonzero(n >= max(1, min_n))
        at = (n[ask] - 1) * q
        out = []
        for which, rank in enumerate((np.floor(at), np.ceil(at))):
            some = ask if which == 0 else ask[rank > np.floor(at)]
            code, k = ranks.kth(np.zeros(len(some), np.int64), before[some], rank if which == 0 else rank[rank > np.floor(at)], base)
            out.append((pos[some], np.full(len(some), which), code, k))
        pos, which, code, k = (np.concatenate(c) for c in zip(*out))
        h, seg = (np.full(len(pos), part.as_py()) for part in key)
        return pa.table({"__h": pa.array(h, pa.int32()), "__seg": pa.array(seg, pa.int64()), "__pos": pa.array(pos, pa.int64()), "which": pa.array(which, pa.int32()), "__b": pa.array(code, pa.int32()), "k": pa.array(k, pa.int64())})

    return run


def _picked(key, left, right):
    """Rows of a value bucket, and queries of a time segment for its k-th smallest value before a place."""
    import pyarrow as pa

    pos, value = left.column("__pos").to_numpy(), left.column("__v").to_numpy()
    by = np.argsort(pos, kind="stable")
    values, code = np.unique(value[by], return_inverse=True)
    at, k = right.column("__pos").to_numpy(), right.column("k").to_numpy()
    found = PrefixRanks(code, max(1, len(values))).kth(np.zeros(len(at), np.int64), np.searchsorted(pos[by], at), k)[0]
    h = np.full(len(at), key[0].as_py())
    return pa.table({"__h": pa.array(h, pa.int32()), "__pos": right.column("__pos"), "which": right.column("which"), "value": pa.array(values[found] if len(at) else np.zeros(0))})


def expanding_hot(rows: DataFrame, q: float, min_n: int, limit: int, biggest: int) -> DataFrame:
    """``__h``, ``__pos``, quantile of the values before it, for keys ``__h`` split by both axes.

    ``rows`` is stored: __h, __pos (place in the key's order), __n (known values before it), __v.  Time segments hold
    ``limit`` rows.  Value buckets lie between the cut points of a quantile sketch, and every cut point is a bucket of its
    own, so a frequent value needs no rows.  A segment knows how many earlier rows fall in each bucket, finds the bucket
    of each of its queries, and the rank inside; there the rows of the bucket answer, copied to the segments that ask.
    """
    m = max(2, 2 * -(-biggest // limit))
    cuts = cut_lineage(rows.groupBy("__h").agg(F.array_sort(F.array_distinct(F.coalesce(F.percentile_approx("__v", [i / m for i in range(1, m)], 20 * m), F.array().cast("array<double>")))).alias("__cuts")))
    i = F.size(F.filter("__cuts", lambda c: c < F.col("__v")))
    bucket = F.when(F.col("__v").isNotNull(), 2 * i + F.coalesce((F.get("__cuts", i) == F.col("__v")).cast("int"), F.lit(0)))
    placed = rows.join(F.broadcast(cuts), "__h").withColumn("__b", bucket).withColumn("__seg", F.floor(F.col("__pos") / limit))
    placed = cut_lineage(placed.drop("__cuts"))
    cells = placed.filter("__b IS NOT NULL").groupBy("__h", "__seg", "__b").count()
    ends = placed.groupBy("__h").agg(F.max("__seg").alias("last"))
    grid = cuts.join(ends, "__h").select("__h", F.size("__cuts").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("__seg"))
    grid = grid.select("__h", "__seg", F.explode(F.sequence(F.lit(0), 2 * F.col("n"))).alias("__b")).join(cells, ["__h", "__seg", "__b"], "left")
    upto = F.sum("count").over(Window.partitionBy("__h", "__b").orderBy("__seg").rowsBetween(FIRST, -1))
    base = grid.select("__h", "__seg", F.struct("__b", F.coalesce(upto, F.lit(0)).alias("c")).alias("s")).groupBy("__h", "__seg")
    base = base.agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["c"]).alias("base"))
    asked = placed.groupBy("__h", "__seg").cogroup(base.groupBy("__h", "__seg")).applyInArrow(_places(q, min_n), "__h int, __seg long, __pos long, which int, __b int, k long")
    asked = cut_lineage(asked)
    point = F.pmod("__b", F.lit(2)) == 1
    known = asked.filter(point).join(F.broadcast(cuts), "__h").select("__h", "__pos", "which", F.get("__cuts", F.floor(F.col("__b") / 2).cast("int")).alias("value"))
    asked = asked.filter(~point).withColumn("__to", F.col("__seg") + 0)
    held = placed.filter("__v IS NOT NULL").select("__h", "__b", "__pos", "__v").join(asked.select("__h", "__b", (F.col("__seg") + 0).alias("__for")).distinct(), ["__h", "__b"])
    found = held.groupBy("__h", "__b", "__for").cogroup(asked.groupBy("__h", "__b", "__to")).applyInArrow(_picked, "__h int, __pos long, which int, value double")
    ends = known.unionByName(found).groupBy("__h", "__pos").agg(*[F.max(F.when(F.col("which") == w, F.col("value"))).alias(n) for w, n in enumerate(("low", "high"))])
    at = (F.col("__n") - 1) * F.lit(q)
    between = (F.floor(at) + 1 - at) * F.col("low") + (at - F.floor(at)) * F.col("high")
    return rows.join(ends, ["__h", "__pos"], "left").select("__h", "__pos", F.coalesce(between, "low").alias("__value"))


def numbered_hot(df: DataFrame, hot: HotKeys) -> tuple[DataFrame, DataFrame]:
    """Cold rows, and hot rows with ``__h``, the number of their key."""
    names = hot.table.select(*hot.keys).collect()  # at most rows/limit keys
    schema = hot.table.select(*hot.keys).schema.add("__h", T.IntegerType())
    return tag_hot(df, hot, df.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(names)], schema))
