"""Best-fit packing of documents into sequences of a fixed number of tokens, in bulk-synchronous rounds.

Documents (pieces) and gaps (what is free in an open sequence) are range-sorted by their size.  In each round the
largest documents left sweep over the gaps for their successor, the smallest gap that holds them.  Where more documents
want a gap than there are sequences with it, the rank inside the size decides who gets one; the others go on to the next
gap or, when there is none, open sequences.  Gaps shrink, and the next round begins.

Sizes are whole numbers up to the capacity, so all documents of one size want the same gap: the sweep moves *runs* (size,
first rank, count), of which there are at most as many as steps, whatever the number of documents.  A round's decisions
are a few intervals of ranks; documents get theirs by a distributed ranking inside the size and a look-up of the interval.
So nothing of the size of the data is gathered, and the result is that of best-fit decreasing, one document at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import pieces, running_total, stored
from .tokens import Encoder

RANK_BUCKETS = 4096
#: Chunks whose ids a worker keeps: fewer than for files, as stages of a pipeline share the executors.
MOST_CHUNKS = 300_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(tokenizer: str, mode: str, end_id: int, capacity: int):
    def run(batches) -> Iterator:
        import zlib

        import pyarrow as pa

        for batch in pieces(batches, "text", 2 << 20):
            ids, width = Encoder.of(tokenizer, mode, MOST_CHUNKS).encode(batch.column("text"))
            flat = np.insert(ids, np.cumsum(width), end_id).astype("<u4")
            width = width + 1
            first = np.cumsum(width) - width
            n = -(-width // capacity)
            which = np.repeat(np.arange(len(width)), n)
            piece = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, width[which] - start)
            at = first[which] + start
            crc = [zlib.crc32(flat[a : a + k]) for a, k in zip(at, length)]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").take(pa.array(which)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start),
                "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()),
            })

    return run


def cut_documents(docs: DataFrame, tokenizer: str, mode: str = "words", end_id: int = 0, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document: its ids and ``end_id``, cut only where longer than the capacity.  Null text: empty."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(_cut(tokenizer, mode, end_id, capacity), PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rounds over the size classes.  Returns runs (size, first rank, count, first sequence, offset).

    ``counts`` has at most ``capacity`` entries.  ``gaps`` holds runs of sequences with one gap, so a successor sweep of
    a class walks over gap sizes, not over sequences.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    runs, opened = [], 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        gap = size
        while left:
            while gap <= capacity and not gaps.get(gap):
                gap += 1
            if gap > capacity:  # no gap holds this size: open sequences, each filled with as many as fit
                fit = capacity // size
                full, part = divmod(left, fit)
                for k in range(fit):
                    n = full + (k < part)
                    if n:
                        runs.append((size, rank, n, opened, k * size))
                        rank += n
                if full and capacity - fit * size:
                    gaps.setdefault(capacity - fit * size, []).append((opened, full))
                if part:
                    gaps.setdefault(capacity - part * size, []).append((opened + full, 1))
                opened += full + bool(part)
                left = 0
                continue
            first, n = gaps[gap].pop()
            take = min(n, left)
            if take < n:
                gaps[gap].append((first + take, n - take))
            runs.append((size, rank, take, first, capacity - gap))
            if gap - size:
                gaps.setdefault(gap - size, []).append((first, take))
            rank, left, gap = rank + take, left - take, size
    return runs


def pack(found: DataFrame, capacity: int = 2048, name: str = "pack") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (columns doc_id, piece, start, length, ids_crc32).

    Repeated rows are pieces of their own; ties inside a size go by a hash of the key, then piece and start.  Null keys
    are keys like any other.  Empty table: no rows.
    """
    found = stored(found, f"{name}-pieces")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    runs = plan(counts, capacity)
    hashed = F.xxhash64("doc_id", "piece")
    bucket = F.shiftrightunsigned(hashed, 64 - RANK_BUCKETS.bit_length() + 1).cast("int")
    order = [F.shiftrightunsigned(hashed, 1), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    ranked = running_total(found, ["length"], bucket, order, F.lit(1).cast("long"), "__n", "rank")
    return ranked.select(*found.columns, "rank").mapInArrow(_place(runs, capacity), PIECES + ", sequence_id long, offset long")


def _place(runs: list[tuple[int, int, int, int, int]], capacity: int):
    """Looks up each row's run: the last one of its size whose first rank isn't above the row's."""
    size, rank0, _, seq0, offset = np.array(sorted(runs), np.int64).reshape(-1, 5).T
    sections = [np.searchsorted(size, k) for k in range(capacity + 2)]

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                own = length == k
                a, b = sections[k], sections[k + 1]
                at[own] = a + np.searchsorted(rank0[a:b], rank[own], side="right") - 1
            yield pa.record_batch({
                **{c: batch.column(c) for c in batch.schema.names if c != "rank"},
                "sequence_id": pa.array(seq0[at] + rank - rank0[at]), "offset": pa.array(offset[at]),
            })

    return run
