"""Exact n-gram Jaccard join with PartEnum signatures.

Sets are banded by size so that linked sets are in the same or neighbouring bands.  Two linked sets of bands i - 1 and i
differ in at most k(i) shingles.  The shingle domain is hashed into n1 = (k + 2) // 2 parts of three cells; in at least
one part the sets differ in at most one shingle, so two of its three cells are the same.  A set's signatures are all
parts with one cell left out: linked sets share one, and two sets that share one agree on about seven shingles.

* Equal sets are one set from the start (members keep a row each), so copies make no pairs.
* Signatures travel as packed arrays by bucket, one for each task, with the 40 bits that their bucket doesn't tell; a chance
  agreement is only one candidate more.  A set's id goes with all its signatures of a bucket, which are counted.  A bucket returns the distinct lists of sets that share a signature.
* For each list the set with the most entries is the centre; a family is a centre and all sets of its lists.  Every
  candidate pair is inside a family.  First each set is compared exactly with its heaviest centre only.  Lists that lie in
  more than one component after that form families again: their sets outside the centre's component are compared with
  every other one.  Sketches (a byte for each cell) rule out sets with too many different cells, which is most of them;
  the rest is decided by counting common shingles in an inverted list.  No pair is ever a row.  Large families are cut into
  blocks, and the sets in focus visit every block.
* Links found (a spanning forest of each block) give the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import mix, pieces, runs, shuffle_partitions, slices, stored, utf8
from .components import components
from .shingles import set_ids, shingle_sets
from .tokens import Encoder

#: Sets of one family that a task compares at a time.
BLOCK_SETS = 2000
#: Ids that are sent to all executors when texts are looked up; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: Text bytes hashed at a time.
PIECE = 4 << 20


def bands(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Least size of each band, and k: the most shingles by which linked sets of the band and the one below differ.
    Entry k[i + 1] also covers pairs inside band i."""
    low, high = [1], []
    while low[-1] <= largest:
        high.append(low[-1] * 100 // percent)
        low.append(high[-1] + 1)
    high += [low[-1] * 100 // percent]
    k = [0] + [(100 - percent) * (a + b) // (100 + percent) for a, b in zip(high[:-1], high[1:])]
    return np.array(low, np.int64), np.array(k, np.int64)


def _cells(hashed: np.ndarray, offsets: np.ndarray, percent: int, step: int):
    """The cells of all sets for pairs with the band below (step 0), or inside the band and with the one above (step 1):
    band of the pairs, k and number of parts by set; hash sums (parts x 3), 0 for an empty cell."""
    size = np.diff(offsets)
    low, k_of = bands(percent, int(size.max()))
    at = np.maximum(np.searchsorted(low, size, side="right") - 1 + step, 0)
    k = np.where(size > 0, k_of[np.minimum(at, len(k_of) - 1)], 0)
    n1 = np.where(k > 0, (k + 2) // 2, 0)
    base = np.cumsum(n1) - n1
    total = np.zeros(int(n1.sum()) * 3, np.uint64)
    live = np.repeat(k > 0, size)
    own, h = np.repeat(np.arange(len(size)), size)[live], hashed[live]
    part = ((h >> np.uint64(32)) * n1[own].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    cell = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(3) >> np.uint64(32)).astype(np.int64)
    np.add.at(total, (base[own] + part) * 3 + cell, mix(h, 11))
    return at, k, n1, total.reshape(-1, 3)


def signatures(hashed: np.ndarray, offsets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set) of all sets.

    An agreement on two empty cells says nothing, so such signatures are left out, unless more than half of the k + 1
    differences could hide there: where twice the number of parts without two empty cells is at most k.  If two linked
    sets share no other signature, that holds for both of them.
    """
    out_sig, out_set = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for step in (0, 1) if len(hashed) else ():
        at, k, n1, total = _cells(hashed, offsets, percent, step)
        base = np.cumsum(n1) - n1
        filled = total != 0
        whose = np.repeat(np.arange(len(n1)), n1)
        sums = np.concatenate([[0], np.cumsum(filled.sum(axis=1) >= 2)])
        needs_empty = (2 * (sums[base + n1] - sums[base]) <= k)[whose]
        seed = mix((at[whose].astype(np.uint64) << np.uint64(32)) + (np.arange(len(whose)) - base[whose]).astype(np.uint64), 5)
        for left_out in range(3):
            a, b = [c for c in range(3) if c != left_out]
            keep = filled[:, a] | filled[:, b] | needs_empty
            out_sig.append(mix(seed[keep] + np.uint64(left_out) + mix(total[keep, a], 1) + mix(total[keep, b], 2)))
            out_set.append(whose[keep])
    return np.concatenate(out_sig), np.concatenate(out_set)


def sketches(hashed: np.ndarray, offsets: np.ndarray, percent: int) -> list[bytes]:
    """One byte of each cell's hash, for step 0 and then step 1: cells that show different bytes differ."""
    if not len(hashed):
        return [b""] * (len(offsets) - 1)
    parts = []
    for step in (0, 1):
        _, _, n1, total = _cells(hashed, offsets, percent, step)
        ends = np.concatenate([[0], np.cumsum(3 * n1)])
        raw = (mix(total.ravel(), 13) & np.uint64(0xFF)).astype(np.uint8).tobytes()
        parts.append([raw[x:y] for x, y in zip(ends[:-1], ends[1:])])
    return [x + y for x, y in zip(*parts)]


def _members(width: int, percent: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        Encoder.forget()
        for batch in pieces(batches, "text", PIECE):
            body, offsets = utf8(batch.column("text"))
            hashed, at = shingle_sets(body, offsets, width)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_shingles": pa.array(np.diff(at)), "set_id": pa.array(set_ids(hashed, at)), "sketch": pa.array(sketches(hashed, at, percent), pa.binary()), "text_hash": batch.column("text_hash")})

    return run


def _packets(width: int, percent: int, buckets: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        Encoder.forget()
        for batch in pieces(batches, "text", PIECE):
            body, offsets = utf8(batch.column("text"))
            hashed, at = shingle_sets(body, offsets, width)
            ids, size = set_ids(hashed, at), np.diff(at)
            _, first = np.unique(ids, return_index=True)  # copies once
            first = first[size[first] > 0]
            ids = ids[first]
            sig, own = signatures(hashed[slices(at[first], size[first])], np.concatenate([[0], np.cumsum(size[first])]), percent)
            bucket = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            by = np.lexsort((own, bucket))
            sig, own, bucket = sig[by], own[by], bucket[by]
            cut = np.flatnonzero(np.diff(bucket)) + 1
            rows = []
            for a, b in zip([0, *cut], [*cut, len(sig)]):
                if b > a:
                    some, count = np.unique(own[a:b], return_counts=True)
                    rows.append((int(bucket[a]), sig[a:b].view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), count.astype(np.uint32).tobytes(), ids[some].tobytes()))
            if rows:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "sig", "count", "ids"])

    return run


def _lists(batches) -> Iterator:
    """The distinct lists of two or more sets that share a signature: list, set_id."""
    import pyarrow as pa

    sigs, ids = [], []
    for batch in batches:
        for bucket, sig, count, known in zip(*(batch.column(c).to_pylist() for c in ("bucket", "sig", "count", "ids"))):
            wide = np.zeros((len(sig) // 5, 8), np.uint8)
            wide[:, :5] = np.frombuffer(sig, np.uint8).reshape(-1, 5)
            sigs.append(wide.view("<u8").ravel() | np.uint64(bucket << 40))
            ids.append(np.repeat(np.frombuffer(known, np.int64), np.frombuffer(count, np.uint32)))
    if not sigs:
        return
    sig, own = np.concatenate(sigs), np.concatenate(ids)
    del sigs, ids
    by = np.argsort(sig, kind="stable")
    sig, own = sig[by], own[by]
    same = np.zeros(len(sig), bool)
    same[1:] = sig[1:] == sig[:-1]
    some = same.copy()
    some[:-1] |= same[1:]
    sig, own = sig[some], own[some]
    if not len(sig):
        return
    by = np.lexsort((own, sig))
    sig, own = sig[by], own[by]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
    sig, own = sig[new], own[new]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(start, len(sig)))
    start, size = start[size > 1], size[size > 1]
    if not len(start):
        return
    total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(mix(own.astype(np.uint64), 9))])
    name = mix(total[start + size] - total[start] + size.astype(np.uint64))
    name, first = np.unique(name, return_index=True)
    start, size = start[first], size[first]
    yield pa.record_batch({"list": pa.array(np.repeat(name.astype(np.int64), size)), "set_id": pa.array(own[slices(start, size)])})


VISITS = "array<struct<centre:long,block:int,set_id:long,own:boolean,focus:boolean>>"
CONTENTS = "centre long, block int, set_id long, own boolean, focus boolean, content binary"


def _contents(width: int):
    """The shingles of each text, one row for each visit of its set to a block of a family."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        names = ("centre", "block", "set_id", "own", "focus")
        for batch in pieces(batches, "text", PIECE):
            body, offsets = utf8(batch.column("text"))
            hashed, at = shingle_sets(body, offsets, width)
            ids = set_ids(hashed, at)
            rows = [(v, hashed[at[k] : at[k + 1]].tobytes()) for k, visits in enumerate(batch.column("visits").to_pylist()) for v in visits if v["set_id"] == ids[k]]
            if rows:
                columns = [pa.array([v[c] for v, _ in rows], t) for c, t in zip(names, (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_()))]
                yield pa.record_batch([*columns, pa.array([c for _, c in rows], pa.binary())], names=[*names, "content"])

    return run


def linked(sets: list[np.ndarray], focus: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set in ``focus`` (indexes), the indexes of all sets it links with, itself included."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    by = np.argsort(flat, kind="stable")
    value, own = flat[by], np.repeat(np.arange(len(sets)), size)[by]
    for i in focus:
        a, b = np.searchsorted(value, sets[i]), np.searchsorted(value, sets[i], side="right")
        common = np.bincount(own[slices(a, b - a)], minlength=len(sets))
        yield i, np.flatnonzero(100 * common >= percent * (size + size[i] - common))


def _compare(percent: int):
    """Blocks of families, sorted: compares the sets in focus with all others.  Returns a spanning forest of the links."""
    def of_block(rows) -> list[tuple[int, int]]:
        ids, own = rows.column("set_id").to_numpy(), rows.column("own").to_numpy()
        sets = [np.frombuffer(c, np.uint64) for c in rows.column("content").to_pylist()]
        root = list(range(len(ids)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        links = []
        for i, found in linked(sets, np.flatnonzero(rows.column("focus").to_numpy()), percent):
            for j in found:
                if (own[i] or own[j]) and find(i) != find(j):
                    root[find(j)] = find(i)
                    links.append((ids[i], ids[j]))
        return links

    def run(batches) -> Iterator:
        import pyarrow as pa

        for rows in runs(batches, ["centre", "block"]):
            links = of_block(rows)
            if links:
                a, b = zip(*links)
                yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _screen(percent: int):
    """Blocks of families, sorted: which sets may link at all with one in focus (or are in focus and have such a one).

    Linked sets differ in at most k shingles, so in at most k cells.
    """
    def of_block(size, sketch, focus) -> np.ndarray:
        low, k_of = bands(percent, int(size.max()))
        band = np.searchsorted(low, size, side="right") - 1
        k0, k1 = k_of[np.minimum(band, len(k_of) - 1)], k_of[np.minimum(band + 1, len(k_of) - 1)]
        cells = [3 * np.where(k > 0, (k + 2) // 2, 0) for k in (k0, k1)]
        stay = np.zeros(len(size), bool)
        tables = {}
        for b in np.unique(band):
            own = np.flatnonzero(band == b)
            c0, c1 = int(cells[0][own[0]]), int(cells[1][own[0]])
            rows = np.frombuffer(b"".join(sketch[i] for i in own), np.uint8).reshape(len(own), c0 + c1)
            tables[b] = own, rows[:, :c0], rows[:, c0:]
        for i in np.flatnonzero(focus):
            own, _, upper = tables[band[i]]
            mine = upper[own == i][0]
            for b, step, k in ((band[i], 1, k1[i]), (band[i] + 1, 0, k1[i])):
                if b in tables and k > 0:
                    those = tables[b][0]
                    near = those[((tables[b][1 + step] != mine).sum(axis=1) <= k) & (those != i)]
                    stay[near] = True
                    stay[i] |= len(near) > 0
            if band[i] - 1 in tables and k0[i] > 0:
                mine = tables[band[i]][1][own == i][0]
                those, _, lower = tables[band[i] - 1]
                near = those[(lower != mine).sum(axis=1) <= k0[i]]
                stay[near] = True
                stay[i] |= len(near) > 0
        return stay

    def run(batches) -> Iterator:
        import pyarrow as pa

        for rows in runs(batches, ["centre", "block"]):
            focus = rows.column("focus").to_numpy()
            stay = of_block(rows.column("n_shingles").to_numpy(), rows.column("sketch").to_pylist(), focus)
            if stay.any():
                yield pa.record_batch([rows.column(c).combine_chunks().filter(pa.array(stay)) for c in ("centre", "set_id", "focus")], names=["centre", "set_id", "focus"])

    return run


def _visits(family: DataFrame) -> DataFrame:
    """Sets have a home block in their family; those in focus visit all its blocks."""
    sizes = family.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("blocks"))
    home = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    block = F.explode(F.when(F.col("focus"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(home)))
    visits = family.join(sizes, "centre").select("centre", "set_id", "focus", home.alias("home"), block.alias("block"))
    return visits.withColumn("own", F.col("home") == F.col("block")).drop("home")


def links_inside(docs: DataFrame, family: DataFrame, sets: DataFrame, shingle: int, percent: int, name: str) -> DataFrame:
    """Links of families (columns centre, set_id, focus): the sets in focus against all of their family.

    First their sketches meet, a tenth of the size, and leave the sets that may link.  The text of such a set's first
    document is looked up by id (a set that only rows without an id have: by the hash of its text), so contents move once,
    straight to their blocks.
    """
    parts = shuffle_partitions(docs.sparkSession)
    rough = _visits(family).join(sets.select("set_id", "n_shingles", "sketch"), "set_id").drop("own")
    rough = rough.repartition(parts, "centre", "block").sortWithinPartitions("centre", "block").select("centre", "block", "set_id", "focus", "n_shingles", "sketch")
    family = rough.mapInArrow(_screen(percent), "centre long, set_id long, focus boolean").groupBy("centre", "set_id").agg(F.max("focus").alias("focus"))
    family = stored(family, f"{name}-screened")
    visit = F.struct("centre", "block", "set_id", "own", "focus")
    visits = _visits(family).join(sets.select("set_id", "rep", "rep_hash"), "set_id").groupBy(F.col("rep").alias("__id"), F.when(F.col("rep").isNull(), F.col("rep_hash")).alias("__hash")).agg(F.collect_list(visit).cast(VISITS).alias("visits"))
    visits = stored(visits, f"{name}-visits")
    visits = F.broadcast(visits) if visits.count() <= BROADCAST_IDS else visits
    found = docs.filter("doc_id IS NOT NULL").join(visits.filter("__id IS NOT NULL"), F.col("doc_id") == F.col("__id")).select("text", "visits")
    nameless = docs.filter("doc_id IS NULL AND text IS NOT NULL").dropDuplicates(["text"])  # one row speaks for a text
    found = found.unionByName(nameless.join(visits.filter("__id IS NULL"), F.xxhash64("text") == F.col("__hash")).select("text", "visits"))
    contents = found.mapInArrow(_contents(shingle), CONTENTS)
    dealt = contents.repartition(parts, "centre", "block").sortWithinPartitions("centre", "block")
    return stored(dealt.mapInArrow(_compare(percent), "a long, b long"), f"{name}-links")


def jaccard_components(docs: DataFrame, shingle: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text", name: str = "jaccard") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest key linked with it, itself included).

    Two documents link when 100 * common shingles >= percent * all shingles of both.  Null and empty texts, and those
    without a word, have no shingle and link with nothing.  Repeated rows and equal texts link with each other.  A null
    key takes part, but a component is named by its smallest key that isn't null.  Empty table: no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    members = stored(rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_members(shingle, percent), "doc_id long, n_shingles long, set_id long, sketch binary, text_hash long"), f"{name}-members")
    sets = members.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min("text_hash").alias("rep_hash"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    sets = stored(sets, f"{name}-sets")
    parts = shuffle_partitions(spark)
    packets = rows.filter(F.col("text").isNotNull()).mapInArrow(_packets(shingle, percent, parts), "bucket int, sig binary, count binary, ids binary")
    lists = stored(packets.repartitionById(parts, F.col("bucket")).mapInArrow(_lists, "list long, set_id long").distinct(), f"{name}-lists")
    weight = lists.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    weighed = lists.join(weight, "set_id")
    heaviest = weighed.groupBy("list").agg(F.max(F.struct("n", "set_id")).alias("centre"))
    lists = stored(weighed.join(heaviest, "list").select("list", "set_id", "centre"), f"{name}-lists")
    # 1. every set with the heaviest centre of its lists
    first = lists.groupBy("set_id").agg(F.max("centre")["set_id"].alias("centre")).filter(F.col("centre") != F.col("set_id"))
    first = first.select("centre", "set_id", F.lit(False).alias("focus"))
    first = stored(first.unionByName(first.select("centre", F.col("centre").alias("set_id"), F.lit(True).alias("focus")).distinct()), f"{name}-first")
    edges = links_inside(rows, first, sets, shingle, percent, f"{name}-first")
    of = components(edges, f"{name}-components").withColumnRenamed("node", "set_id")
    # 2. lists that are not in one component yet: what isn't in the centre's component, with all of the family
    now = lists.select("list", "set_id", F.col("centre.set_id").alias("centre")).join(of, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    split = now.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.when(F.col("set_id") == F.col("centre"), F.col("component"))).alias("main")).filter("low <> high")
    family = now.join(split.select("list", "main"), "list").groupBy("centre", "set_id").agg(F.max(F.col("component") != F.col("main")).alias("focus"))
    more = links_inside(rows, stored(family, f"{name}-family"), sets, shingle, percent, f"{name}-second")
    edges = edges.unionByName(more)
    # names of components: the smallest document of all its sets
    of = components(edges, f"{name}-all-components")
    named = sets.join(of.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", "rep", F.coalesce("component", "set_id").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = stored(named.join(least, "component").select("set_id", "component_id"), f"{name}-names")
    out = members.filter("n_shingles > 0").join(named, "set_id").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(members.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", name: str = "near-duplicates") -> DataFrame:
    """``docs`` with keep: of each component the row with the smallest key stays.

    Documents without words link with nothing and stay, and so do rows without a key.  Of rows that repeat a key, one
    with the smallest text stays.  Only ids are looked up, so texts move only where these are too many to broadcast.
    """
    docs = docs.drop("keep")
    found = stored(jaccard_components(docs, shingle, percent, key, text, name).select("doc_id", "component_id"), f"{name}-found")
    drop = stored(found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__id")).distinct(), f"{name}-drop")
    repeated = stored(found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__id")), f"{name}-repeated")

    def marked(df: DataFrame, ids: DataFrame) -> DataFrame:
        ids = ids.withColumn("__in", F.lit(True))
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        return df.join(ids, F.col(key) == F.col("__id"), "left").drop("__id")

    out = marked(docs, drop).withColumn("keep", F.col("__in").isNull()).drop("__in")
    if not repeated.isEmpty():
        again = marked(out, repeated).withColumn("__again", F.col("__in").isNotNull()).drop("__in")
        number = F.row_number().over(Window.partitionBy(key).orderBy(F.col("keep").desc(), F.col(text)))
        once = again.filter("__again").withColumn("keep", F.col("keep") & (number == 1))
        out = again.filter(~F.col("__again")).unionByName(once).drop("__again")
    return out
