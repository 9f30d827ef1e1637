"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

* Rows are sorted along a Hilbert curve through the dimensions that vary most and stored as Parquet blocks: one Parquet
  row for each ``BLOCK`` candidates, beside it the least and greatest value of every dimension and label.
* For an anchor and a block, interval arithmetic on the zone map bounds all inner products the block can hold.  First the
  positives: an anchor's own block gives a score that its last positive reaches at least, and only blocks whose bound
  comes up to it and that may hold the label are read.  Then the negatives: only blocks whose bounds meet one of the
  anchor's windows are read.
* The zone maps meet the anchors by tile (neighbouring anchors) and slice of the curve; a block that an anchor of a tile
  needs goes to the task of this tile and the block's stretch of the curve.  Inside, the bounds choose again by anchor.
* Scores are inner products of whole numbers: exact, so results don't depend on how the rows are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored
from .vectors import common_length, complete, matrix

#: Candidates in a block, and at most about as many in a stretch of the curve, which one task holds.
BLOCK, STRETCH = 1024, 200_000
#: Anchors of a tile, at least, and stretches in a slice of zone maps.
TILE, SLICE = 4000, 64
#: Dimensions of the curve and bits of each.
CURVE, BITS = 8, 7
#: Scores that a task holds at a time.
CELLS = 500_000


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (rows x dimensions, below 2^bits)."""
    x = cells.astype(np.int64).copy()
    n, d = x.shape
    for level in range(bits - 1, 0, -1):  # undo the turns and mirrorings of every level, the coarsest first
        low = (1 << level) - 1
        for i in range(d):
            high = (x[:, i] >> level) & 1
            swap = np.where(high == 1, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high == 1, low, swap)
            x[:, i] ^= swap
    for i in range(1, d):  # Gray code
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, d - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn[:, None]
    place = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            place = (place << 1) | ((x[:, i] >> level) & 1)
    return place


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and b, whole numbers as doubles: exact, or an error beyond 2^53."""
    most = a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    if most >= 2.0**53:
        raise ArithmeticError("scores beyond 2^53: use a smaller scale")
    return (a @ b.T).astype(np.int64)


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval arithmetic: least and greatest inner product of each row of a with anything between low and high."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def _spread(scale: int):
    """One row for each dimension: number, sum, sum of squares, least and greatest of floor(scale * x) in the task."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.floor(matrix(batch.column("vector")) * scale)
            own = np.stack([np.full(x.shape[1], len(x)), x.sum(0), (x * x).sum(0), x.min(0), x.max(0)])
            total = own if total is None else np.concatenate([total[:3] + own[:3], np.minimum(total[3:4], own[3:4]), np.maximum(total[4:], own[4:])])
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(total.shape[1], dtype=np.int32)), *[pa.array(t) for t in total]], names=["dim", "n", "total", "squares", "low", "high"])

    return run


def _placed(scale: int, dims: list[int], low: np.ndarray, high: np.ndarray):
    """Whole numbers in place of the vectors, and the place on the curve."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.floor(matrix(batch.column("vector")) * scale)
            cells = np.floor((x[:, dims] - low) / np.maximum(high - low, 1) * ((1 << BITS) - 1))
            place = hilbert(cells, BITS)
            yield pa.record_batch([*[batch.column(c) for c in ("vec_id", "label", "anchor")], pa.array([v.tobytes() for v in x], pa.binary()), pa.array(place)], names=["vec_id", "label", "anchor", "vector", "place"])

    return run


BLOCKS = "block long, stretch int, n int, ids binary, labels binary, anchors binary, vectors binary, wide boolean, low binary, high binary, label_low long, label_high long"


def _blocks():
    """Sorted rows of a stretch -> blocks."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        stretch = TaskContext.get().partitionId()
        held, number = [], 0

        def block(rows):
            ids, labels = (rows.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
            flags = np.asarray(rows.column("anchor").to_numpy(), bool)
            x = np.frombuffer(b"".join(rows.column("vector").to_pylist())).reshape(len(ids), -1)
            by = np.argsort(ids, kind="stable")
            ids, labels, flags, x = ids[by], labels[by], flags[by], x[by]
            wide = bool(np.abs(x).max(initial=0) >= 2**24)
            return pa.record_batch({
                "block": [(stretch << 32) + number], "stretch": pa.array([stretch], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": [ids.tobytes()],
                "labels": [labels.tobytes()], "anchors": [flags.tobytes()], "vectors": [x.astype(np.float64 if wide else np.float32).tobytes()], "wide": [wide],
                "low": [x.min(0).tobytes()], "high": [x.max(0).tobytes()], "label_low": [int(labels.min())], "label_high": [int(labels.max())]})

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            while sum(b.num_rows for b in held) >= BLOCK:
                rows = pa.Table.from_batches(held)
                yield block(rows.slice(0, BLOCK))
                number += 1
                held = rows.slice(BLOCK).to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    return run


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids (ascending), labels and vectors of a block."""
    x = np.frombuffer(row["vectors"], np.float64 if row["wide"] else np.float32).reshape(row["n"], -1).astype(np.float64)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), x


def _order(scores: np.ndarray) -> np.ndarray:
    """Numbers in the order of score, then of the smaller column: columns are candidates by id."""
    n = scores.shape[1]
    if np.abs(scores).max(initial=0) >= 2**50:
        scores = np.unique(scores, return_inverse=True)[1].reshape(scores.shape)
    return scores * BLOCK + (n - 1 - np.arange(n))


def _best(order: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k first of each row among those that are ok."""
    order = np.where(ok, order, np.iinfo(np.int64).min)
    if order.shape[1] > k:
        columns = np.argpartition(order, order.shape[1] - k, axis=1)[:, -k:]
    else:
        columns = np.broadcast_to(np.arange(order.shape[1]), order.shape)
    live = np.take_along_axis(ok, columns, 1)
    row, at = np.nonzero(live)
    return row, columns[row, at]


def _first_of(keys: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k first rows (greatest score, then smallest id) of every key."""
    by = np.lexsort((ids, -scores, keys))
    keys = keys[by]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    return by[np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys)))) < k]


def _anchors_of(k: int):
    """Blocks -> their anchors, with the k-th best score of their label in the block (null where there are fewer)."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                at = np.flatnonzero(np.frombuffer(row["anchors"], bool))
                if not len(at):
                    continue
                ids, labels, x = _opened(row)
                score = products(x[at], x)
                ok = (labels[at][:, None] == labels[None]) & (ids[at][:, None] != ids[None])
                floor = [np.sort(s[o])[-k] if o.sum() >= k else None for s, o in zip(score, ok)]
                yield pa.record_batch({"anchor_id": pa.array(ids[at]), "label": pa.array(labels[at]), "vector": pa.array([v.tobytes() for v in x[at]], pa.binary()), "floor": pa.array(floor, pa.int64()), "stretch": pa.array(np.full(len(at), row["stretch"], np.int32))})

    return run


class _Anchors:
    """The anchors of a tile, with the least score that matters (positives) or their windows (negatives)."""

    def __init__(self, rows, low: int, high: int):
        self.ids, self.labels = (rows.column(c).to_numpy().astype(np.int64) for c in ("anchor_id", "label"))
        raw = rows.column("vector").to_pylist()
        self.x = np.frombuffer(b"".join(raw)).reshape(len(raw), -1)
        self.low, self.high, self.windows = low, high, None
        if "floor" in rows.schema.names:
            floor = rows.column("floor").to_pylist()
            self.floor = np.array([-math.inf if f is None else f for f in floor])
        else:  # an anchor's distinct positive scores; empty ones become windows that nothing meets
            of = rows.column("scores").to_pylist()
            width = max((len(w) for w in of), default=0)
            self.windows = np.zeros((len(of), width), np.int64)
            self.real = np.zeros((len(of), width), bool)
            for i, w in enumerate(of):
                self.windows[i, : len(w)], self.real[i, : len(w)] = w, True

    def needs(self, low: np.ndarray, high: np.ndarray, label_low: np.ndarray, label_high: np.ndarray) -> np.ndarray:
        """anchors x blocks: whether a block may hold rows that an anchor looks for."""
        least, most = bounds(self.x, low, high)
        slack = 0.5 + 1e-9 * (np.abs(least) + np.abs(most))  # rounding of the bounds
        label = self.labels[:, None]
        if self.windows is None:
            return (most + slack >= self.floor[:, None]) & (label_low <= label) & (label <= label_high)
        other = ~((label_low == label) & (label_high == label))
        meets = np.zeros(least.shape, bool)
        for w in range(self.windows.shape[1]):
            p, real = self.windows[:, w, None], self.real[:, w, None]
            meets |= real & (self.low * p <= 100 * (most + slack)) & (100 * (least - slack) <= self.high * p)
        return meets & other

    def found(self, row: dict, which: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of one block, for the anchors ``which``: anchor numbers, ids and scores of the k first rows (of each window)."""
        ids, labels, x = _opened(row)
        out = []
        step = max(1, CELLS // len(ids))
        for lo in range(0, len(which), step):
            some = which[lo : lo + step]
            score = products(self.x[some], x)
            order = _order(score)
            same = self.labels[some][:, None] == labels[None]
            if self.windows is None:
                looks = [same & (self.ids[some][:, None] != ids[None]) & (score >= self.floor[some][:, None])]
            else:
                p, real = self.windows[some], self.real[some]
                looks = [real[:, w, None] & ~same & (self.low * p[:, w, None] <= 100 * score) & (100 * score <= self.high * p[:, w, None]) for w in range(p.shape[1])]
            for ok in looks:
                i, j = _best(order, ok, k)
                out.append((some[i], ids[j], score[i, j]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        at, near, score = (np.concatenate(c) for c in zip(*out))
        if self.windows is not None and len(at):  # windows overlap
            by = np.unique(np.stack([at, near, score]), axis=1)
            at, near, score = by
        return at, near, score


def _zones(low: int, high: int):
    """Anchors of a tile and zone maps of a slice -> the blocks that any of the anchors needs."""
    def run(key, left, right):
        import pyarrow as pa

        if not left.num_rows or not right.num_rows:
            return pa.table({"tile": pa.array([], pa.int32()), "block": pa.array([], pa.int64())})
        anchors = _Anchors(left, low, high)
        d = anchors.x.shape[1]
        lows, highs = (np.frombuffer(b"".join(right.column(c).to_pylist())).reshape(-1, d) for c in ("low", "high"))
        label_low, label_high = (right.column(c).to_numpy() for c in ("label_low", "label_high"))
        need = np.zeros(right.num_rows, bool)
        step = max(1, CELLS // len(anchors.ids))
        for lo in range(0, right.num_rows, step):
            part = slice(lo, lo + step)
            need[part] = anchors.needs(lows[part], highs[part], label_low[part], label_high[part]).any(0)
        block = right.column("block").to_numpy()[need]
        return pa.table({"tile": pa.array(np.full(len(block), key[0].as_py(), np.int32)), "block": pa.array(block)})

    return run


def _read(k: int, low: int, high: int):
    """Anchors of a tile and the blocks they need in a stretch -> the rows of these blocks that may be among the first k."""
    def run(key, left, right):
        import pyarrow as pa

        at, near, score = (np.zeros(0, np.int64),) * 3
        if left.num_rows and right.num_rows:
            anchors = _Anchors(left, low, high)
            d = anchors.x.shape[1]
            for batch in right.to_batches(max_chunksize=16):
                for row in batch.to_pylist():
                    zone = [np.frombuffer(row[c]).reshape(1, d) for c in ("low", "high")] + [np.array([row[c]]) for c in ("label_low", "label_high")]
                    which = np.flatnonzero(anchors.needs(*zone)[:, 0])
                    found = anchors.found(row, which, k)
                    at, near, score = (np.concatenate([a, b]) for a, b in zip((at, near, score), found))
                    if len(at) > 4_000_000:
                        at, near, score = _kept(anchors, at, near, score, k)
            at, near, score = _kept(anchors, at, near, score, k)
            at = anchors.ids[at]
        return pa.table({"anchor_id": pa.array(at), "vec_id": pa.array(near), "score": pa.array(score)})

    return run


def _kept(anchors: _Anchors, at: np.ndarray, near: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if anchors.windows is None:
        keep = _first_of(at, near, score, k)
        return at[keep], near[keep], score[keep]
    keep = np.zeros(len(at), bool)
    for w in range(anchors.windows.shape[1]):
        p = anchors.windows[at, w]
        inside = np.flatnonzero(anchors.real[at, w] & (anchors.low * p <= 100 * score) & (100 * score <= anchors.high * p))
        keep[inside[_first_of(at[inside], near[inside], score[inside], k)]] = True
    return at[keep], near[keep], score[keep]


def _search(anchors: DataFrame, blocks: DataFrame, zones: DataFrame, tiles: int, slices: int, k: int, low: int, high: int, name: str) -> DataFrame:
    """anchor_id, vec_id, score of the rows that may be among the first k, from the blocks that the zone maps leave."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    need = stored(
        anchors.withColumn("slice", every(slices)).groupBy("tile", "slice")
        .cogroup(zones.withColumn("tile", every(tiles)).groupBy("tile", "slice")).applyInArrow(_zones(low, high), "tile int, block long"), f"{name}-needed")
    need = need.withColumn("stretch", F.shiftright("block", 32).cast("int"))
    asked = anchors.join(need.select("tile", "stretch").distinct(), "tile")
    read = blocks.join(need.select("tile", "block"), "block")
    return asked.groupBy("tile", "stretch").cogroup(read.groupBy("tile", "stretch")).applyInArrow(_read(k, low, high), "anchor_id long, vec_id long, score long")


def hard_negatives(
    df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    key: str = "vec_id", vector: str = "embedding", label: str = "label", name: str = "hard-negatives",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which ``anchors`` holds.  A score is the inner product of floor(scale * x) of two rows.  An
    anchor's positives are its first ``positives`` other rows of its label, by score, then by smaller id; for each, the
    first ``negatives`` rows of other labels whose score is between ``low`` and ``high`` per cent of the positive's.  Fewer
    such rows: all of them; none: no row.  Labels are whole numbers.

    Rows with a null id or label, a null or empty vector, one with a null or non-finite component or of another length
    than most take no part; a zero vector does.  Rows that repeat an id are one row: that with the smallest label, then the
    smallest vector.  Scores beyond 2^53 raise an ArithmeticError.  Empty table: no rows.
    """
    spark = df.sparkSession
    d = common_length(df, vector)
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & complete(F.col("vector")) & (F.size("vector") == F.lit(d or 0)))
    twice = stored(rows.groupBy("vec_id").count().filter("count > 1").select("vec_id"), f"{name}-repeated")
    if not twice.isEmpty():
        one = rows.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "vector", "anchor")).alias("r")).select("vec_id", "r.*")
        rows = rows.join(twice, "vec_id", "left_anti").unionByName(one)
    dims = rows.select("vector").mapInArrow(_spread(scale), "dim int, n double, total double, squares double, low double, high double")
    dims = dims.groupBy("dim").agg(F.sum("n").alias("n"), (F.sum("squares") - F.sum("total") * F.sum("total") / F.sum("n")).alias("vary"), F.min("low").alias("low"), F.max("high").alias("high"))
    dims = dims.orderBy(F.desc("vary"), "dim").limit(CURVE).collect()
    if not dims:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    placed = rows.mapInArrow(_placed(scale, [r["dim"] for r in dims], np.array([r["low"] for r in dims]), np.array([r["high"] for r in dims])), "vec_id long, label long, anchor boolean, vector binary, place long")
    stretches = max(spark.sparkContext.defaultParallelism, math.ceil(dims[0]["n"] / STRETCH))
    sorted_ = placed.repartitionByRange(stretches, "place", "vec_id").sortWithinPartitions("place", "vec_id")
    blocks = stored(sorted_.mapInArrow(_blocks(), BLOCKS), f"{name}-blocks")
    last = blocks.agg(F.max("stretch")).first()[0]
    zones = blocks.select("block", "low", "high", "label_low", "label_high", F.floor(F.col("stretch") / SLICE).cast("int").alias("slice"))
    asked = stored(blocks.mapInArrow(_anchors_of(positives), "anchor_id long, label long, vector binary, floor long, stretch int"), f"{name}-anchors")
    tiles = max(1, min(last + 1, math.ceil(asked.count() / TILE)))
    asked = asked.withColumn("tile", F.floor(F.col("stretch") * tiles / (last + 1)).cast("int")).drop("stretch")
    found = _search(asked, blocks, zones, tiles, last // SLICE + 1, positives, low, high, f"{name}-positives")
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    near = found.withColumn("rank", rank).filter(F.col("rank") <= positives)
    near = stored(near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), f"{name}-positive-rows")
    windows = near.groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))  # at most ``positives``
    looking = stored(asked.drop("floor").join(windows, "anchor_id"), f"{name}-windows")
    found = _search(looking, blocks, zones, tiles, last // SLICE + 1, negatives, low, high, f"{name}-negatives")
    inside = (low * F.col("positive_score") <= 100 * F.col("score")) & (100 * F.col("score") <= high * F.col("positive_score"))
    pairs = near.join(found, "anchor_id").filter(inside)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id"))
    out = pairs.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
