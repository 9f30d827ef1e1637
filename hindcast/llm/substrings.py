"""Removal of long repeated byte strings with suffix sorting.

A byte goes when a string of ``length`` bytes over it also starts in a document with a smaller id.

Sorting every suffix of the corpus would move fifty times its size.  Each window of ``length`` bytes is therefore known
by its anchor (suffixes.anchors): equal windows have equal anchors, and about one place in fourteen is one.

1. Whole copies of a text are settled by its hash.
2. Hashes of anchors meet by bucket; those that stand in two or more documents go back to these documents.
3. Documents cut out the segments around such anchors.  Of equal segments among the documents of one group only the one
   with the smallest id travels on; the others are covered by it.
4. Per bucket, all windows of the segments are suffix-sorted: multikey quicksort to a shallow depth, blind tries for
   what is left.  The smallest id of each class of equal windows tells which windows go.
5. The byte ranges meet their documents, which count and hash what is left.

Texts move once: both times they are needed, in 3 and 5, they come from the same exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import pieces, shuffle_partitions, slices, stored, utf8
from .suffixes import anchors, deep_shallow

#: Ids of copies that are sent to all executors; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: Windows sorted at a time.
SORTED = 400_000
PIECE = 4 << 20
LAST = (1 << 63) - 1  # stands for a null id


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _name(h: np.ndarray) -> np.ndarray:
    """What is left of an anchor's hash inside its bucket; windows are compared as a whole later."""
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _packed(key: np.ndarray, *columns: np.ndarray):
    """(key, bytes of each column) for each key."""
    by = np.argsort(key, kind="stable")
    key = key[by]
    columns = [c[by] for c in columns]
    cut = np.flatnonzero(np.diff(key)) + 1
    for a, b in zip([0, *cut], [*cut, len(key)]):
        if b > a:
            yield (int(key[a]), *(c[a:b].tobytes() for c in columns))


def _anchor_packets(length: int, buckets: int):
    """rid, text -> bucket, names, rids of the anchors (once for each document)."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches, "text", PIECE):
            body, offsets = utf8(batch.column("text"))
            h, _, _, doc = anchors(body, offsets, length)
            if not len(h):
                continue
            rid, bucket, name = batch.column("rid").to_numpy(), _buckets(h, buckets), _name(h)
            by = np.lexsort((doc, name, bucket))
            h, doc, bucket, name = h[by], doc[by], bucket[by], name[by]
            new = np.ones(len(h), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (name[1:] != name[:-1]) | (bucket[1:] != bucket[:-1])
            rows = []
            for b, names, docs in _packed(bucket[new], name[new], doc[new].astype(np.uint32)):
                some, at = np.unique(np.frombuffer(docs, np.uint32), return_inverse=True)
                rows.append((b, names, at.astype(np.uint16 if len(some) < 65536 else np.uint32).tobytes(), rid[some].tobytes()))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "names", "at", "rids"])

    return run


def _repeated(groups: int):
    """Per partition of buckets: names of anchors in two or more documents, packed for the groups of these documents."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for bucket, names, at, rids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                name = np.frombuffer(names, np.uint32)
                at = np.frombuffer(at, np.uint16 if len(at) == 2 * len(name) else np.uint32)
                parts.append((np.full(len(name), bucket, np.uint64) << np.uint64(32) | name, np.frombuffer(rids, np.int64), at))
        if not parts:
            return
        name = np.concatenate([p[0] for p in parts])
        by = np.argsort(name, kind="stable")
        same = name[by][1:] == name[by][:-1]
        some = np.zeros(len(name), bool)
        some[by[1:]] |= same
        some[by[:-1]] |= same
        rid = np.concatenate([p[1][p[2]] for p in parts])[some]
        rows = list(_packed(rid % groups, rid, name[some]))
        if rows:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["grp", "rids", "names"])

    return run


SEGMENTS = "bucket int, names binary, grp int, ids binary, rids binary, starts binary, counts binary, texts binary"


def _segments(length: int, buckets: int):
    """A group of documents and their repeated anchors -> segments by bucket, and ranges that are settled here.

    A row with grp holds ranges (rids, starts, counts of bytes) to pass on; one without holds segments.
    """
    def run(docs, lists):
        import pyarrow as pa

        schema = pa.schema([("bucket", pa.int32()), ("names", pa.binary()), ("grp", pa.int32()), ("ids", pa.binary()), ("rids", pa.binary()), ("starts", pa.binary()), ("counts", pa.binary()), ("texts", pa.binary())])
        if not docs.num_rows or not lists.num_rows:
            return schema.empty_table()
        docs = docs.sort_by("id")
        body, offsets = utf8(docs.column("text"))
        rid, ids = docs.column("rid").to_numpy(), docs.column("id").to_numpy()
        h, first, last, doc = anchors(body, offsets, length)
        full = (_buckets(h, buckets).astype(np.uint64) << np.uint64(32)) | _name(h)
        want_rid = np.concatenate([np.frombuffer(x, np.int64) for x in lists.column("rids").to_pylist()])
        want_name = np.concatenate([np.frombuffer(x, np.uint64) for x in lists.column("names").to_pylist()])
        pair = lambda r, m: r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ m * np.uint64(0xC2B2AE3D27D4EB4F)
        keep = np.isin(pair(rid[doc], full), pair(want_rid, want_name))
        h, first, last, doc = h[keep], first[keep], last[keep], doc[keep]
        if not len(h):
            return schema.empty_table()
        size = last - first + length
        # equal segments: same hash of their bytes and windows
        seen: dict[bytes, int] = {}
        raw = body.tobytes()
        least = np.zeros(len(h), np.int64)
        for k, (a, n) in enumerate(zip(first.tolist(), size.tolist())):  # in the order of ids
            least[k] = seen.setdefault(raw[a : a + n], k)
        covered = ids[doc] > ids[doc[least]]
        grp = int(docs.column("grp")[0].as_py())
        rows = []
        place = (first - offsets[doc]).astype(np.uint32)
        if covered.any():
            rows.append((grp % buckets, None, grp, None, rid[doc[covered]].tobytes(), place[covered].tobytes(), size[covered].astype(np.uint32).tobytes(), None))
        go = np.flatnonzero(~covered)
        bucket = _buckets(h[go], buckets)
        by = np.argsort(bucket, kind="stable")
        go, bucket = go[by], bucket[by]
        cut = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *cut], [*cut, len(go)]):
            if b > a:
                own = go[a:b]
                text = body[slices(first[own], size[own])].tobytes()
                rows.append((int(bucket[a]), _name(h[own]).tobytes(), None, ids[doc[own]].tobytes(), rid[doc[own]].tobytes(), place[own].tobytes(), (last[own] - first[own] + 1).astype(np.uint16).tobytes(), text))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _sorted_ranges(length: int, groups: int):
    """Segments of some buckets -> ranges of bytes that go, packed for the groups of their documents."""
    def ranges(name, ids, rid, start, count, body):
        """One round over segments with few windows in all; equal windows have equal names."""
        at = np.cumsum(count + length - 1) - (count + length - 1)
        own = np.repeat(np.arange(len(count)), count)
        windows = slices(at, count)
        order, group = deep_shallow(body, windows, length)
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        least = np.minimum.reduceat(ids[own[order]], begin)[group]
        goes = np.zeros(len(windows), bool)
        goes[order] = least < ids[own[order]]
        first = goes.copy()
        first[1:] &= ~(goes[:-1] & (own[1:] == own[:-1]))
        last = goes.copy()
        last[:-1] &= ~(goes[1:] & (own[1:] == own[:-1]))
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        within = windows - at[own]
        return rid[own[a]], (start[own[a]] + within[a]).astype(np.uint32), (b - a + length).astype(np.uint32)

    def run(batches) -> Iterator:
        import pyarrow as pa

        def rows(found):
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*found), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["grp", "rids", "starts", "sizes"])

        held, own_bucket = [], None

        def settle():
            name, ids, rid, start, count, text = ([np.frombuffer(r[i], t) for r in held] for i, t in enumerate((np.uint32, np.int64, np.int64, np.uint32, np.uint16, np.uint8)))
            name, ids, rid, start = (np.concatenate(x) for x in (name, ids, rid, start))
            count, body = np.concatenate(count).astype(np.int64), np.concatenate(text)
            size = count + length - 1
            at = np.cumsum(size) - size
            by = np.argsort(name, kind="stable")
            total = np.cumsum(count[by])
            new = np.flatnonzero(np.concatenate([[True], name[by][1:] != name[by][:-1]]))
            part = np.zeros(len(by), np.int64)
            part[new] = total[new] // SORTED
            part = np.maximum.accumulate(part)
            cut = np.flatnonzero(np.diff(part)) + 1
            out = []
            for a, b in zip([0, *cut], [*cut, len(by)]):
                some = by[a:b]
                out.append(ranges(name[some], ids[some], rid[some], start[some].astype(np.int64), count[some], np.ascontiguousarray(body[slices(at[some], size[some])])))
            rid, start, size = (np.concatenate(x) for x in zip(*out))
            return list(_packed(rid % groups, rid, start, size))

        for batch in batches:
            for bucket, names, grp, ids, rids, starts, counts, texts in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if grp is not None:
                    yield rows([(grp, rids, starts, counts)])
                    continue
                if bucket != own_bucket and held:
                    found = settle()
                    held = []
                    if found:
                        yield rows(found)
                own_bucket = bucket
                held.append((names, ids, rids, starts, counts, texts))
        if held:
            found = settle()
            if found:
                yield rows(found)

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def _removed(docs, ranges):
    """A group of documents and their ranges -> what is left of each."""
    import pyarrow as pa

    body, offsets = utf8(docs.column("text"))
    rid = docs.column("rid").to_numpy()
    mark = np.zeros(len(body) + 1, np.int64)
    if ranges.num_rows:
        of = np.concatenate([np.frombuffer(x, np.int64) for x in ranges.column("rids").to_pylist()])
        start = np.concatenate([np.frombuffer(x, np.uint32) for x in ranges.column("starts").to_pylist()]).astype(np.int64)
        size = np.concatenate([np.frombuffer(x, np.uint32) for x in ranges.column("sizes").to_pylist()]).astype(np.int64)
        by = np.argsort(rid, kind="stable")
        for side in ("left", "right"):  # rows that repeat a document: the first and the last of them
            at = np.searchsorted(rid[by], of, side=side) - (side == "right")
            begin = offsets[by[at]] + start
            np.add.at(mark, begin, 1)
            np.add.at(mark, begin + size, -1)
        for k in np.flatnonzero((rid[by][1:-1] == rid[by][:-2]) & (rid[by][1:-1] == rid[by][2:])) + 1:  # and those between
            own = of == rid[by[k]]
            np.add.at(mark, offsets[by[k]] + start[own], 1)
            np.add.at(mark, offsets[by[k]] + start[own] + size[own], -1)
    gone = np.cumsum(mark[:-1]) > 0
    edge = gone.copy()
    edge[1:] &= ~gone[:-1]
    edge[offsets[:-1][offsets[:-1] < len(body)]] |= gone[offsets[:-1][offsets[:-1] < len(body)]]
    total, runs_ = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(edge)])
    stop = gone.copy()
    stop[:-1] &= ~gone[1:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] <= len(body))] - 1
    stop[inner] |= gone[inner]
    starts, ends = np.flatnonzero(edge), np.flatnonzero(stop) + 1
    sha, spans = [], []
    for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        sha.append(hashlib.sha256(body[a:b][~gone[a:b]].tobytes()).hexdigest())
        x, y = runs_[a], runs_[b]
        spans.append([{"start": int(s - a), "end": int(e - a)} for s, e in zip(starts[x:y], ends[x:y])])
    return pa.table({
        "doc_id": docs.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(total[offsets[1:]] - total[offsets[:-1]]), "n_spans": pa.array(runs_[offsets[1:]] - runs_[offsets[:-1]]),
        "kept_sha256": pa.array(sha, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    })


def repeated_substrings(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text", name: str = "substrings") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay) and spans
    (maximal removed runs, in bytes).

    Null and empty texts, and those shorter than ``length``, lose nothing.  A null id counts as larger than all others.
    Rows with one id don't cover each other; repeated rows have equal results.  Empty table: no rows.
    """
    spark = docs.sparkSession
    groups = buckets = 4 * shuffle_partitions(spark)
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rid = F.shiftrightunsigned(F.xxhash64("id", "text"), 1).alias("rid")
    info = rows.select("doc_id", "id", rid, F.md5("text").alias("md5"), F.octet_length(F.col("text").cast("binary")).cast("long").alias("n_bytes"))
    info = stored(info.withColumn("sha", F.lit(None).cast("string")), f"{name}-texts")
    copied = info.filter(F.col("n_bytes") >= length).groupBy("md5").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    copies = stored(info.join(copied, "md5").filter(F.col("id") > F.col("first")).select("doc_id", "rid", "n_bytes"), f"{name}-copies")
    ids = copies.select("rid").distinct()
    ids = F.broadcast(ids) if copies.count() <= BROADCAST_IDS else ids
    long_ = rows.withColumn("rid", rid).filter(F.octet_length(F.col("text").cast("binary")) >= length).join(ids, "rid", "left_anti")
    long_ = long_.select("doc_id", "id", "rid", "text", F.pmod(F.col("rid"), F.lit(groups)).cast("int").alias("grp"))
    packets = long_.select("rid", "text").mapInArrow(_anchor_packets(length, buckets), "bucket int, names binary, at binary, rids binary")
    lists = packets.repartition(shuffle_partitions(spark), "bucket").mapInArrow(_repeated(groups), "grp int, rids binary, names binary")
    segments = long_.groupBy("grp").cogroup(lists.groupBy("grp")).applyInArrow(_segments(length, buckets), SEGMENTS)
    ranges = segments.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(_sorted_ranges(length, groups), "grp int, rids binary, starts binary, sizes binary")
    out = long_.groupBy("grp").cogroup(ranges.groupBy("grp")).applyInArrow(_removed, RESULT)
    short = docs.select(F.col(key).cast("long").alias("doc_id"), data.alias("data")).filter(F.octet_length("data") < length)
    nothing, none = F.lit(0).cast("long"), F.array().cast("array<struct<start:int,end:int>>")
    short = short.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"), F.sha2("data", 256).alias("kept_sha256"), none.alias("spans"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    copies = copies.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), whole.alias("spans"))
    return out.unionByName(short).unionByName(copies)
