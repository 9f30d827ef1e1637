"""Byte-pair encoding of a corpus with content-defined chunk reuse, and decoding.

* A rolling hash of 32 bytes cuts every text where its top bits are zero, so equal passages are cut alike wherever they
  stand.  A chunk is known by a 128-bit digest of its bytes; only digests are counted, not texts moved.
* A chunk that several documents share is encoded by one of them, all other chunks by the document that has them.
* Cuts fall inside words, where the ids of two chunks don't add up to those of the text.  A join is repaired by encoding
  a window around it anew: the last words of one chunk and the first of the next.  The window must agree with the chunks
  in the ids of its outer words; where it does not, the document's windows are doubled until all do, at last up to the
  whole document.  A chunk without enough spaces becomes part of the window.
* Documents that wait for a chunk of another document are put together from their pieces by document.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..plans.hot import BROADCAST_CONF, DEFAULT_BROADCAST_BYTES
from .common import pieces, runs, shared_folder, slices, spread_join, stored, utf8
from .tokens import Encoder

#: Bytes of a chunk: at least, at most, and bits that are zero at a cut (2 KB more on average).
LEAST, MOST, BITS = 512, 8192, 11
#: Words on each side of a join that are encoded anew first; two, so that the outer ones can be compared.
WORDS = 2
#: Words of which a worker keeps the ids; bytes of text, and ids, that it handles at a time.
KEPT, PIECE, IDS = 500_000, 2 << 20, 1 << 17

_GEAR = np.random.default_rng(13).integers(0, 2**32, 256, dtype=np.uint32)
_WORD = re.compile(r"[^ \n]+")


def chunk_ends(body: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """The ends of the chunks of each text, as places in ``body``.  No cut is inside a character."""
    h = _GEAR[body]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    begins = np.ones(len(body) + 1, bool)
    begins[:-1] = (body & 0xC0) != 0x80
    may = (np.flatnonzero((h >> np.uint32(32 - BITS) == 0) & begins[1:]) + 1).tolist()
    out = []
    for at, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        ends = []
        while end - at > LEAST:  # the hash looks back 32 bytes, so it never sees the text before
            k = bisect_left(may, at + LEAST)
            cut = may[k] if k < len(may) and may[k] <= at + MOST else at + MOST
            while cut < end and not begins[cut]:
                cut -= 1
            at = min(cut, end)
            ends.append(at)
        if at < end:
            ends.append(end)
        out.append(ends)
    return out


def _chunks(column) -> Iterator[list[bytes]]:
    """The chunks of each text of an Arrow column; none for null and empty texts."""
    body, offsets = utf8(column)
    raw = body.tobytes()
    for at, ends in zip(offsets.tolist(), chunk_ends(body, offsets)):
        yield [raw[a:b] for a, b in zip([at, *ends], ends)]


def _digest(chunk: bytes) -> bytes:
    return blake2b(chunk, digest_size=16).digest()


def _counted(batches) -> Iterator:
    """key, text -> one row for each different chunk of a document."""
    import pyarrow as pa

    for batch in pieces(batches, "text", PIECE):
        keys, digests = [], []
        for key, chunks in zip(batch.column("key").to_pylist(), _chunks(batch.column("text"))):
            own = {_digest(c) for c in chunks}
            keys += [key] * len(own)
            digests += own
        yield pa.record_batch({"key": pa.array(keys, pa.int64()), "digest": pa.array(digests, pa.binary())})


def _head(text: str, words: int) -> int | None:
    """The place after the first ``words`` words and the spaces behind them."""
    found = re.match(r"[ \n]*(?:[^ \n]+[ \n]+){%d}" % words, text)
    return found.end() if found else None


def _tail(text: str, words: int) -> int | None:
    """The place where the last ``words`` words begin, behind a space."""
    at = len(text)
    for _ in range(words):
        end = len(text[:at].rstrip(" \n"))
        at = max(text.rfind(" ", 0, end), text.rfind("\n", 0, end)) + 1
        if not at:
            return None
    return at


def layout(chunks: list[str], words: int) -> list[tuple]:
    """Windows (text, first word, last word) and chunks (number, head, tail) of a text in turn.

    A chunk's ids count without those of head and tail, which are in the windows beside it.  The outer words of a window
    are empty where it begins or ends with the text or with a chunk that is wholly inside."""
    out: list[tuple] = []
    pending = first = ""
    for i, s in enumerate(chunks):
        head = 0 if i == 0 else _head(s, words)
        tail = len(s) if i == len(chunks) - 1 else _tail(s, words)
        if head is None or tail is None or head > tail:
            pending += s
            continue
        if pending or head:
            out.append((pending + s[:head], first, _WORD.findall(s[:head])[-1] if head else ""))
        out.append((i, s[:head], s[tail:]))
        pending = s[tail:]
        first = _WORD.match(pending).group() if pending else ""
    if pending:
        out.append((pending, first, ""))
    return out


class _Batch:
    """Encodes strings of a batch of documents, each kind in one call."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.texts: list[str] = []
        self.windows: list[str] = []

    def text(self, s: str) -> int:
        self.texts.append(s)
        return len(self.texts) - 1

    def window(self, s: str) -> int:
        self.windows.append(s)
        return len(self.windows) - 1

    def encode(self):
        flat, count = self.encoder.encode(self.texts) if self.texts else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        ends = np.cumsum(count)
        self.ids = lambda k: flat[ends[k] - count[k] : ends[k]]
        self.count = count
        self.fresh = [np.array(e.ids, np.int32) for e in self.encoder.tokenizer.encode_batch_fast(self.windows, add_special_tokens=False)] if self.windows else []


def _planned(batch: _Batch, chunks: list[str], elsewhere: list[bool], words: int) -> list[tuple]:
    plan = []
    for part in layout(chunks, words):
        if isinstance(part[0], str):
            plan.append((None, batch.window(part[0]), *[batch.text(w) if w else None for w in part[1:]]))
        else:
            i, head, tail = part
            plan.append((i, None if elsewhere[i] else batch.text(chunks[i]), batch.text(head) if head else None, batch.text(tail) if tail else None))
    return plan


def _joined(batch: _Batch, plan: list[tuple]) -> list | None:
    """Arrays of ids and holes (chunk number, ids to leave out at both ends); None where a window does not agree."""
    out: list = []
    for i, own, first, last in plan:
        if i is None:
            ids = batch.fresh[own]
            for word, end in ((first, ids[: batch.count[first]] if first is not None else None), (last, ids[len(ids) - batch.count[last] :] if last is not None else None)):
                if word is not None and not np.array_equal(batch.ids(word), end):
                    return None
            out.append(ids)
            continue
        cut = [0 if k is None else int(batch.count[k]) for k in (first, last)]
        if own is None:
            out.append((i, *cut))
        else:
            ids = batch.ids(own)
            out.append(ids[cut[0] : len(ids) - cut[1]])
    return out


ENCODED = "kind int, uid long, doc_id long, seq int, ids binary, digest binary, head int, tail int"
#: Whole documents, pieces of documents that wait for others, chunks for others.
WHOLE, PIECES, SHARED = 0, 1, 2


def _encoded(path: str, width: str):
    """Documents with the digests of their shared chunks -> rows of ENCODED."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = Encoder.of(path, "words", KEPT)
        uid = TaskContext.get().partitionId() << 40
        for rows in pieces(batches, "text", PIECE):
            out: dict[str, list] = {f.split()[0]: [] for f in ENCODED.split(", ")}

            def put(**row):
                for name, column in out.items():
                    column.append(row.get(name))

            batch, documents, shared = _Batch(encoder), [], []
            for doc_id, digests, mine, raw in zip(*[rows.column(c).to_pylist() for c in ("doc_id", "digests", "mine")], _chunks(rows.column("text"))):
                texts, own = [c.decode() for c in raw], dict(zip(digests or [], mine or []))
                of = [_digest(c) for c in raw] if own else [b""] * len(raw)
                for digest, text in dict(zip(of, texts)).items():
                    if own.get(digest):
                        shared.append((digest, batch.text(text)))
                elsewhere = [d in own and not own[d] for d in of]
                documents.append((doc_id, texts, of, elsewhere, _planned(batch, texts, elsewhere, WORDS)))
            batch.encode()
            for doc_id, texts, of, elsewhere, plan in documents:
                parts, words = _joined(batch, plan), WORDS
                while parts is None:
                    words *= 2
                    again = _Batch(encoder)
                    plan = _planned(again, texts, elsewhere, words)
                    again.encode()
                    parts = _joined(again, plan)
                uid += 1
                seq, held = 0, []
                for part in [*parts, None]:
                    if isinstance(part, np.ndarray):
                        held.append(part)
                        continue
                    ids = np.concatenate(held or [np.zeros(0, np.int32)]).astype(width).tobytes()
                    if part is None and not seq:
                        put(kind=WHOLE, uid=uid, doc_id=doc_id, ids=ids)
                        break
                    put(kind=PIECES, uid=uid, doc_id=doc_id, seq=seq, ids=ids)
                    if part is not None:
                        put(kind=PIECES, uid=uid, doc_id=doc_id, seq=seq + 1, digest=of[part[0]], head=part[1], tail=part[2])
                    seq, held = seq + 2, []
            for digest, k in shared:
                put(kind=SHARED, digest=digest, ids=batch.ids(k).astype(width).tobytes())
            types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
            yield pa.record_batch([pa.array(out[f.split()[0]], types[f.split()[1]]) for f in ENCODED.split(", ")], names=list(out))

    return run


def _documents(ids: list, values: list[np.ndarray], text):
    """doc_id and ids as an Arrow batch; with ``text``, a function of lists of ids, their decoded texts as well."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values or [np.zeros(0, np.int32)]).astype(np.int32)))
    more = [] if text is None else [pa.array(text(values), pa.string())]
    return pa.record_batch([pa.array(ids, pa.int64()), lists, *more], names=["doc_id", "ids", "decoded"][: 2 + len(more)])


def _in_turn(documents: Iterator, text) -> Iterator:
    """Batches of about ``IDS`` ids of (doc_id, ids), one document at least."""
    Encoder.forget()
    ids, values, n = [], [], 0
    for doc_id, own in documents:
        ids.append(doc_id)
        values.append(own)
        n += len(own) + 1
        if n > IDS:
            yield _documents(ids, values, text)
            ids, values, n = [], [], 0
    if ids:
        yield _documents(ids, values, text)


def _opened(width: str, path: str | None):
    def run(batches) -> Iterator:
        rows = (r for batch in batches for r in zip(batch.column("doc_id").to_pylist(), batch.column("ids")))
        yield from _in_turn(((doc_id, np.frombuffer(raw.as_buffer(), width)) for doc_id, raw in rows), _decoder(path))

    return run


def _put_together(width: str, path: str | None):
    """Pieces sorted by document and place -> documents."""
    def of(rows):
        ids = []
        for raw, head, tail in zip(*[rows.column(c).to_pylist() for c in ("ids", "head", "tail")]):
            own = np.frombuffer(raw, width)
            ids.append(own[head or 0 : len(own) - (tail or 0)])
        return rows.column("doc_id")[0].as_py(), np.concatenate(ids)

    def run(batches) -> Iterator:
        yield from _in_turn((of(rows) for rows in runs(batches, ["uid"])), _decoder(path))

    return run


def _decoder(path: str | None):
    """Lists of ids -> texts; None without a vocabulary."""
    if path is None:
        return None
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    token = [(library.id_to_token(i) or "").encode() + b" " for i in range(library.get_vocab_size())]
    flat = np.frombuffer(b"".join(token), np.uint8)
    wide = np.array([len(t) for t in token], np.int64)
    start = np.cumsum(wide) - wide

    def text(values: list[np.ndarray]) -> list[str]:
        ids = np.concatenate(values or [np.zeros(0, np.int64)])
        body = flat[slices(start[ids], wide[ids])].tobytes()
        ends = np.concatenate([[0], np.cumsum(wide[ids])])
        cut = ends[np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)]
        return [body[a : max(b - 1, a)].decode() for a, b in zip(cut, cut[1:])]

    return text


def encode_documents(df: DataFrame, tokenizer: str, decoded: bool = False, key: str = "doc_id", text: str = "text", name: str = "chunk-reuse") -> DataFrame:
    """doc_id, ids (array<int>) of every row: what the library's encode(text, add_special_tokens=False) gives with the
    word-level vocabulary file ``tokenizer``, in which no id reaches across a space.  With ``decoded`` also the text that
    ``decode_documents`` makes of them, in the same pass.

    Null and empty texts have no ids.  Rows that repeat an id, or a whole row, are encoded each; a null id stays null.  A
    text without spaces is encoded as one window.  Other columns don't matter.  Empty table: no rows.
    """
    from tokenizers import Tokenizer

    spark = df.sparkSession
    again, schema = (tokenizer, "doc_id long, ids array<int>, decoded string") if decoded else (None, "doc_id long, ids array<int>")
    width = "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))  # rows with one key would share a list of digests: no harm
    chunks = stored(rows.select("key", "text").mapInArrow(_counted, "key long, digest binary"), f"{name}-chunks")
    shared = chunks.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first")).filter("n > 1")
    shared = stored(shared, f"{name}-shared")
    met = spread_join(chunks, shared, ["digest"], "n", "inner").select("key", "digest", (F.col("key") == F.col("first")).alias("mine")).distinct()
    lists = stored(met.groupBy("key").agg(F.collect_list(F.struct("digest", "mine")).alias("of")).select("key", F.col("of.digest").alias("digests"), F.col("of.mine").alias("mine")), f"{name}-lists")
    told = lists.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("digests")), F.lit(0))).first()
    small = 64 * (told[0] + told[1]) <= float(spark.conf.get(BROADCAST_CONF, str(DEFAULT_BROADCAST_BYTES)))  # bytes, counted
    found = rows.join(F.broadcast(lists) if small else lists.hint("merge"), "key", "left").select("doc_id", "text", "digests", "mine")
    path = shared_folder(spark, f"{name}-encoded")
    found.mapInArrow(_encoded(tokenizer, width), ENCODED).write.option("compression", "zstd").parquet(path)
    encoded = spark.read.schema(ENCODED).parquet(path)
    whole = encoded.filter(F.col("kind") == WHOLE).select("doc_id", "ids").mapInArrow(_opened(width, again), schema)
    parts = encoded.filter(F.col("kind") == PIECES).drop("kind")
    holes = parts.filter("digest IS NOT NULL").drop("ids")
    ready = encoded.filter(F.col("kind") == SHARED).groupBy("digest").agg(F.min("ids").alias("ids"))
    ready = stored(holes.groupBy("digest").count().join(ready, "digest"), f"{name}-ready")
    filled = spread_join(holes, ready, ["digest"], "count", "inner")
    every = parts.filter("digest IS NULL").unionByName(filled).select("uid", "doc_id", "seq", "ids", "head", "tail")
    every = every.repartition("uid").sortWithinPartitions("uid", "seq")
    return whole.unionByName(every.mapInArrow(_put_together(width, again), schema))


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids, decoded: the library's decode(ids, skip_special_tokens=False).  The vocabulary file names no decoder, so
    this is the strings of the tokens with one space between them; null or no ids: an empty text."""
    def run(batches) -> Iterator:
        rows = (r for batch in batches for r in zip(batch.column("doc_id").to_pylist(), batch.column("ids")))
        yield from _in_turn(((doc_id, np.zeros(0, np.int32) if ids.values is None else ids.values.to_numpy()) for doc_id, ids in rows), _decoder(tokenizer))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
