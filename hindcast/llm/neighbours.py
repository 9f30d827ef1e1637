"""Approximate nearest neighbours with balanced posting lists.

* Lists: centroids come from balanced two-way splits of a bounded sample; every vector is indexed.  A vector near a border
  is copied to several lists: to its nearest centroids within ``closure`` times the nearest distance, but not to one that
  lies close to a centroid already chosen.
* The centroids stand in an in-memory graph (near neighbours pruned the same way, and some far ones), searched best-first
  from fixed entry points, for many vectors at a time.
* A query reads the lists whose centroid is within ``ratio`` times the distance of its nearest centroid.  A query that
  finds fewer than k rows there reads all lists.
* Lists and the queries that read them meet in a task; more than ``LIST_ROWS`` rows are dealt over several tasks.
  Each task returns a query's nearest rows, with exact distances, and the best of these are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import shuffle_partitions, stored
from .vectors import dimension, matrix, usable

#: Rows of lists that a task holds.
LIST_ROWS = 50_000
#: Groups of lists that are read together, so that a query sends one result for each.
SLOTS = 64
#: Vectors that centroids are fitted on.
SAMPLE = 20_000
#: A second list must be at least so far from the first, in distances of the vector from it.
SPREAD = 0.3
#: Most centroids; with one per 100 sampled vectors at most.
CENTROIDS = 200


def balanced_centroids(x: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Splits the vectors in two halves of equal size until there are ``count`` groups; their means."""
    rng = np.random.default_rng(seed)
    groups = [np.arange(len(x))]
    while len(groups) < count:
        groups.sort(key=len)
        own = groups.pop()
        if len(own) < 2:
            groups.append(own)
            break
        c = x[rng.choice(own, 2, replace=False)]
        half = len(own) // 2
        for _ in range(8):
            lean = ((x[own] - c[0]) ** 2).sum(1) - ((x[own] - c[1]) ** 2).sum(1)
            by = np.argsort(lean, kind="stable")
            a, b = own[by[:half]], own[by[half:]]
            c = np.array([x[a].mean(0), x[b].mean(0)])
        groups += [a, b]
    return np.array([x[g].mean(0) for g in groups if len(g)])


def graph(c: np.ndarray, degree: int, far: int, seed: int) -> np.ndarray:
    """Neighbour numbers of each centroid: near ones no nearer to each other than to it, then random ones."""
    rng = np.random.default_rng(seed)
    n = len(c)
    d = ((c[:, None, :] - c[None, :, :]) ** 2).sum(2) if n <= 512 else np.array([((c - v) ** 2).sum(1) for v in c])
    out = np.zeros((n, degree + far), np.int64)
    for i in range(n):
        chosen: list[int] = []
        for j in np.argsort(d[i], kind="stable")[1 : 8 * degree]:
            if len(chosen) == degree:
                break
            if all(d[j, k] > d[i, j] for k in chosen):
                chosen.append(int(j))
        near = [int(j) for j in np.argsort(d[i], kind="stable")[1 : degree + 1]]
        chosen += [j for j in near if j not in chosen][: degree - len(chosen)]
        chosen += [i] * (degree - len(chosen))
        out[i] = [*chosen, *rng.integers(0, n, far)]
    return out


def search(x: np.ndarray, c: np.ndarray, links: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search in the graph for all rows of x: distances to and numbers of the centroids seen, the nearest
    ``width`` of them in order (numbers -1 where fewer were seen)."""
    n, rows = len(c), np.arange(len(x))
    norm = (c * c).sum(1)
    seen = np.full((len(x), n), np.inf)

    def visit(which: np.ndarray):  # rows x candidates
        flat = np.einsum("ijk,ik->ij", c[which], x)
        np.put_along_axis(seen, which, norm[which] - 2 * flat, axis=1)

    entry = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(np.int64))
    visit(np.broadcast_to(entry, (len(x), len(entry))))
    done = np.zeros((len(x), n), bool)
    width = min(width, n)
    for _ in range(4 * width):
        best = np.argpartition(seen, width - 1, axis=1)[:, :width]
        value = np.where(np.take_along_axis(done, best, 1), np.inf, np.take_along_axis(seen, best, 1))
        at = value.argmin(1)
        open_ = np.isfinite(value[rows, at])
        if not open_.any():
            break
        which = best[rows, at]
        done[rows, which] = True
        visit(links[which])
    order = np.argsort(seen, axis=1, kind="stable")[:, :width]
    value = np.take_along_axis(seen, order, 1) + (x * x).sum(1)[:, None]
    return np.sqrt(np.maximum(value, 0)), np.where(np.isfinite(value), order, -1)


def _lists_of(fitted, width: int, closure: float, copies: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        c, links = fitted.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                d, near = search(matrix(part.column("vector")), c, links, width)
                ids, lists = [], []
                for i in range(len(d)):
                    chosen = [near[i, 0]]
                    for j in range(1, near.shape[1]):
                        if near[i, j] < 0 or d[i, j] > closure * d[i, 0] or len(chosen) == copies:
                            break
                        if all(((c[k] - c[near[i, j]]) ** 2).sum() > (SPREAD * d[i, j]) ** 2 for k in chosen):
                            chosen.append(near[i, j])
                    ids += [i] * len(chosen)
                    lists += chosen
                yield pa.record_batch({"vec_id": part.column("vec_id").take(pa.array(ids)), "list": pa.array(np.array(lists, np.int32)), "vector": part.column("vector").take(pa.array(ids))})

    return run


def _reads(fitted, width: int, ratio: float):
    def run(batches) -> Iterator:
        import pyarrow as pa

        c, links = fitted.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                d, near = search(matrix(part.column("vector")), c, links, width)
                take, at = np.nonzero((near >= 0) & (d <= ratio * np.maximum(d[:, :1], 1e-12)))
                yield pa.record_batch({"query_id": part.column("vec_id").take(pa.array(take)), "list": pa.array(near[take, at].astype(np.int32)), "vector": part.column("vector").take(pa.array(take))})

    return run


def _nearest(k: int):
    """Some rows of some lists and the queries that read these: the k nearest of each query, by exact distances of doubles."""
    def of_list(v, ids, q, own):
        norm = (v * v).sum(1)
        for lo in range(0, len(q), 64):
            rough = norm - 2 * q[lo : lo + 64] @ v.T
            for i, r in enumerate(rough):
                r[ids == own[lo + i]] = np.inf
                some = np.flatnonzero(np.isfinite(r))
                if len(some) > k:  # rounding can't move a row by more than the slack
                    kth = np.partition(r, k - 1)[k - 1]
                    some = np.flatnonzero(r <= kth + 1e-6 * (1 + abs(kth)))
                score = np.sqrt(((v[some] - q[lo + i]) ** 2).sum(1))
                by = np.lexsort((ids[some], score))[:k]
                yield own[lo + i], ids[some][by], score[by]

    def run(key, left, right):
        import pandas as pd

        best: dict[int, list] = {}
        if len(left) and len(right):
            v, ids, of = np.stack(left["vector"]).astype(np.float64), left["vec_id"].to_numpy(np.int64), left["list"].to_numpy()
            q, own, reads = np.stack(right["vector"]).astype(np.float64), right["query_id"].to_numpy(np.int64), right["list"].to_numpy()
            for name in np.unique(of):
                some, those = of == name, reads == name
                for query, near, score in of_list(v[some], ids[some], q[those], own[those]):
                    best.setdefault(int(query), []).append((near, score))
        out = []
        for query, got in best.items():
            near, score = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            by = np.lexsort((near, score))
            near, score = near[by], score[by]
            _, first = np.unique(near, return_index=True)  # an id may stand in several lists
            first = np.sort(first)[:k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": near[first], "score": score[first]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    return run


def nearest(
    df: DataFrame, queries: Column, k: int = 10, ratio: float = 1.12, closure: float = 1.04, copies: int = 3, width: int = 200, sample: int = SAMPLE,
    seed: int = 11, key: str = "vec_id", vector: str = "embedding", name: str = "neighbours",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which ``queries`` holds, by Euclidean distance.

    The index is fitted on at most ``sample`` vectors (those with the smallest hashes of id and vector) and holds all.
    Vectors that are null, empty, zero, of another length than most, or with a null or non-finite component take no
    part, nor do rows with a null id.  Rows that repeat an id are one row at their nearest; none is its own neighbour.
    Ties go to the smaller id.  Fewer than k candidates: all of them.  Empty table: no rows.
    """
    spark = df.sparkSession
    d = dimension(df, vector)
    rows = df.filter(F.col(key).isNotNull() & usable(F.col(vector)) & (F.size(vector) == F.lit(d or 0)))
    rows = rows.withColumn("__query", F.coalesce(queries, F.lit(False)))
    rows = stored(rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"), "__query"), f"{name}-rows")
    n = rows.count()
    found_schema = "query_id long, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    near_hash = F.xxhash64("vec_id", "vector")
    cut = rows.select(near_hash.alias("h")).agg(F.percentile_approx("h", min(1.0, sample / n), 10000)).first()[0] if n > sample else None
    some = rows.filter(near_hash <= F.lit(cut)) if cut is not None else rows
    x = matrix(some.select("vector").limit(2 * sample).toArrow().column("vector"))  # about ``sample`` rows
    c = balanced_centroids(x, max(1, min(CENTROIDS, len(x) // 100)), seed)
    fitted = spark.sparkContext.broadcast((c, graph(c, 12, 4, seed)))  # at most CENTROIDS rows
    kind = rows.schema["vector"].dataType.simpleString()
    lists = stored(rows.select("vec_id", "vector").mapInArrow(_lists_of(fitted, 16, closure, copies), f"vec_id long, list int, vector {kind}"), f"{name}-lists")
    asked = rows.filter("__query").select("vec_id", "vector")
    slot = F.pmod(F.col("list"), F.lit(SLOTS)).cast("int").alias("slot")
    stored_parts = lists.groupBy(slot).agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).cast("int").alias("parts")).collect()  # at most SLOTS rows
    parts = F.create_map(*[F.lit(v) for r in stored_parts for v in (r["slot"], r["parts"])])
    lists = lists.select("*", slot, F.pmod(F.xxhash64("vec_id"), parts[slot]).cast("int").alias("part"))

    def read(reads: DataFrame, what: str) -> DataFrame:
        reads = reads.select("*", slot).filter(parts[F.col("slot")].isNotNull()).withColumn("part", F.explode(F.sequence(F.lit(0), parts[F.col("slot")] - 1)))
        found = lists.groupBy("slot", "part").cogroup(reads.groupBy("slot", "part")).applyInPandas(_nearest(k), found_schema)
        found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))  # copies of a vector in several lists
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return stored(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), f"{name}-{what}")

    first = read(asked.mapInArrow(_reads(fitted, width, ratio), f"query_id long, list int, vector {kind}"), "found")
    full = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= k).select("query_id")
    short = stored(asked.withColumnRenamed("vec_id", "query_id").join(full, "query_id", "left_anti"), f"{name}-short")
    if short.isEmpty():
        return first
    every = short.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(len(c) - 1))).alias("list"), "vector")
    return first.join(full, "query_id", "left_semi").unionByName(read(every, "refilled"))
