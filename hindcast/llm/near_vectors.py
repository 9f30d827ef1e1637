"""Embedding near-duplicates: random-hyperplane signatures in several tables, exact cosine, connected components.

Equal vectors are one node with a weight, so copies make no pairs.  A signature has so many bits that about
``BUCKET`` random vectors share one, and there are so many tables that a pair at the threshold is missed by all of them
with probability ``miss``.  Rows with one signature meet in a task, where the cosines are computed exactly; buckets above
``BLOCK`` rows are cut into blocks that meet two by two.  A pair counts in the first table in which its signatures agree
(rows carry those of all tables), so links are counted once and never written as rows: a task returns counts per node and
a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import shuffle_partitions, stored
from .components import components
from .vectors import usable

BUCKET = 64
BLOCK = 2000
#: Rows that a task compares at a time.
CHUNK = 20_000


def tables_for(n: int, cosine: float, miss: float) -> tuple[int, int]:
    """(bits of a signature, number of tables) for n vectors."""
    agree = 1 - math.acos(cosine) / math.pi
    bits = min(30, max(4, math.ceil(math.log2(max(n, 1) / BUCKET + 1))))
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - agree**bits)))


def planes(d: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((d, tables * bits))


def _signed(tables: int, bits: int, seed: int, kind: str):
    """node, weight, vector -> one row for each table: node, weight, table and signature (key), all signatures, vector."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        made: dict[int, np.ndarray] = {}
        for batch in batches:
            raw = batch.column("vector").to_pylist()
            lengths = np.array([len(v) for v in raw])
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                d = size // np.dtype(kind).itemsize
                x = np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), d).astype(np.float64)
                if d not in made:
                    made[d] = planes(d, tables, bits, seed)
                sign = (x @ made[d] > 0).reshape(len(at), tables, bits)
                sig = (sign * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2).astype(np.int32)
                node, weight = batch.column("node").take(pa.array(at)), batch.column("weight").take(pa.array(at))
                short = sig.astype(np.uint16 if bits <= 16 else np.uint32)
                own = [short[i].tobytes() for i in range(len(at))]
                for t in range(tables):
                    key = (np.int64(size) << 40) + (np.int64(t) << 30) + sig[:, t]
                    yield pa.record_batch({"node": node, "weight": weight, "key": pa.array(key), "table": pa.array(np.full(len(at), t, np.int32)), "sigs": pa.array(own, pa.binary()), "vector": pa.array([raw[i] for i in at], pa.binary())})

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges a-b (indexes below n) form a spanning forest."""
    root = np.arange(n)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    keep = np.zeros(len(a), bool)
    for k in range(len(a)):
        x, y = find(a[k]), find(b[k])
        if x != y:
            root[max(x, y)] = min(x, y)
            keep[k] = True
    return keep


def _compare(cosine: float, kind: str, sig_kind: str):
    """Rows sorted by (key, i, j): links inside each (key, i, j).  Returns counts (b null) and forest edges."""
    def links(x, side, i_eq_j, sigs, table):
        """Pairs of one bucket that link and have not met in a table before."""
        step = max(1, 4_000_000 // max(len(x), 1))
        for lo in range(0, len(x), step):
            close = (x[lo : lo + step] @ x.T) >= cosine
            a, b = np.nonzero(close)
            a = a + lo
            ok = (a < b) if i_eq_j else (side[a] < side[b])
            a, b = a[ok], b[ok]
            if table and len(a):
                for part in range(0, len(a), 200_000):
                    pa_, pb_ = a[part : part + 200_000], b[part : part + 200_000]
                    fresh = ~(sigs[pa_, :table] == sigs[pb_, :table]).any(axis=1)
                    yield pa_[fresh], pb_[fresh]
            else:
                yield a, b

    def small(x, start, size, sigs, table):
        """The same for many small buckets of a chunk at once."""
        n = size * (size - 1) // 2
        own = np.repeat(np.arange(len(size)), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        j = ((1 + np.sqrt(1 + 8 * k.astype(np.float64))) / 2).astype(np.int64)
        j -= (j * (j - 1) // 2 > k).astype(np.int64)
        i = k - j * (j - 1) // 2
        a, b = start[own] + i, start[own] + j
        for lo in range(0, len(a), 100_000):
            p, q = a[lo : lo + 100_000], b[lo : lo + 100_000]
            ok = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
            p, q = p[ok], q[ok]
            if len(p):
                met = (sigs[p] == sigs[q]) & (np.arange(sigs.shape[1]) < table[p][:, None])
                ok = ~met.any(axis=1)
                yield p[ok], q[ok]

    def block(rows):
        import pyarrow as pa

        node = rows.column("node").to_numpy()
        weight = rows.column("weight").to_numpy()
        key, i, j, own = (rows.column(c).to_numpy() for c in ("key", "i", "j", "own"))
        table = rows.column("table").to_numpy()
        raw, sig = rows.column("vector").to_pylist(), rows.column("sigs").to_pylist()
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(key)))
        length = np.array([len(raw[s]) for s in start])
        out_a, out_b = [], []
        for d in np.unique(length):
            of = np.flatnonzero(length == d)
            at = np.concatenate([np.arange(start[k], start[k] + size[k]) for k in of])
            x = np.frombuffer(b"".join(raw[k] for k in at), kind).reshape(len(at), -1).astype(np.float64)
            x = x / np.sqrt((x * x).sum(axis=1))[:, None]
            sigs = np.frombuffer(b"".join(sig[k] for k in at), sig_kind).reshape(len(at), -1)
            begin = np.cumsum(size[of]) - size[of]
            low = (size[of] <= 16) & (i[start[of]] == j[start[of]])
            for a, b in small(x, begin[low], size[of][low], sigs, table[at]):
                out_a.append(at[a])
                out_b.append(at[b])
            for k in np.flatnonzero(~low):
                s, e = begin[k], begin[k] + size[of][k]
                same = i[start[of[k]]] == j[start[of[k]]]
                for a, b in links(x[s:e], own[at[s:e]], same, sigs[s:e], int(table[at[s]])):
                    out_a.append(at[s + a])
                    out_b.append(at[s + b])
        if not out_a:
            return
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        n = np.bincount(a, weight[b], len(node)) + np.bincount(b, weight[a], len(node))
        u, at = np.unique(node, return_inverse=True)
        total = np.bincount(at, n, len(u)).astype(np.int64)
        some = total > 0
        yield pa.record_batch({"a": pa.array(u[some]), "b": pa.array([None] * int(some.sum()), pa.int64()), "n": pa.array(total[some])})
        keep = _forest(at[a], at[b], len(u))
        if keep.any():
            yield pa.record_batch({"a": pa.array(node[a[keep]]), "b": pa.array(node[b[keep]]), "n": pa.array(np.zeros(int(keep.sum()), np.int64))})

    def run(batches) -> Iterator:
        import pyarrow as pa

        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            held = rows
            if rows.num_rows < CHUNK:
                continue
            key, i, j = (rows.column(c).to_numpy() for c in ("key", "i", "j"))
            last = (key == key[-1]) & (i == i[-1]) & (j == j[-1])
            cut = rows.num_rows - int(last.sum())
            if cut:
                yield from block(rows.slice(0, cut).combine_chunks())
                held = rows.slice(cut)
        if held is not None and held.num_rows:
            yield from block(held.combine_chunks())

    return run


def near_vectors(df: DataFrame, cosine: float = 0.9, miss: float = 1e-3, seed: int = 7, key: str = "vec_id", vector: str = "embedding", name: str = "near-vectors") -> DataFrame:
    """One row per row of ``df``: vec_id, n_links (other rows linked directly), component_id (smallest id linked with it),
    kept (vec_id = component_id).

    Rows link when their cosine in double precision is at least ``cosine``.  Null, empty and zero vectors, and those with
    a null or non-finite component, link with nothing, nor do vectors of different lengths.  Equal vectors and repeated
    rows link with each other.  A null id takes part, but names no component unless it is alone (kept is then null).
    Empty table: no rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    kind = "<f4" if rows.schema["vector"].dataType.simpleString() == "array<float>" else "<f8"  # as stored; computed in doubles
    rows = rows.withColumn("vector", F.col("vector").cast("array<float>" if kind == "<f4" else "array<double>")).withColumn("ok", usable(F.col("vector")))
    rows = stored(rows.mapInArrow(_packed(kind), "vec_id long, vector binary"), f"{name}-rows")
    nodes = rows.filter("vector IS NOT NULL").groupBy("vector").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("rep"))
    nodes = stored(nodes.withColumn("node", F.xxhash64("vector")), f"{name}-nodes")  # equal vectors: one node
    n = nodes.count()
    bits, tables = tables_for(n, cosine, miss)
    nodes_in = nodes.select("node", "weight", "vector")
    signed = nodes_in.mapInArrow(_signed(tables, bits, seed, kind), "node long, weight long, key long, table int, sigs binary, vector binary")
    heavy = stored(nodes_in.mapInArrow(_keys(tables, bits, seed, kind), "key long").groupBy("key").count().filter(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), f"{name}-heavy")
    signed = signed.join(heavy, "key", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")), F.lit(0)).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    met = signed.withColumn("pair", F.explode(pairs)).select("node", "weight", "key", "table", "own", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "sigs", "vector")
    met = met.repartition(4 * shuffle_partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = stored(met.mapInArrow(_compare(cosine, kind, "<u2" if bits <= 16 else "<u4"), "a long, b long, n long"), f"{name}-found")
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    of = components(found.filter("b IS NOT NULL").select("a", "b"), f"{name}-components")
    named = nodes.select("node", "vector", "weight", "rep").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").join(links, "node", "left")
    named = stored(named.select(F.col("node"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), f"{name}-names")
    out = rows.withColumn("node", F.xxhash64("vector")).filter("vector IS NOT NULL").join(named, "node").select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.filter("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _packed(kind: str):
    """Usable vectors as the bytes of their numbers (negative zero as zero), others as null."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ok = batch.column("ok").to_numpy(zero_copy_only=False).astype(bool)
            vectors = batch.column("vector")
            packed = [(np.array(v.as_py(), kind) + np.dtype(kind).type(0)).tobytes() if k else None for v, k in zip(vectors, ok)]
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "vector": pa.array(packed, pa.binary())})

    return run


def _keys(tables: int, bits: int, seed: int, kind: str):
    signed = _signed(tables, bits, seed, kind)

    def run(batches) -> Iterator:
        for batch in signed(batches):
            yield batch.select(["key"])

    return run
