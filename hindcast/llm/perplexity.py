"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

Tokens are UTF-8 bytes, so one model serves all languages and no word is unknown.  Counting is a map-side-combined sum
over the whole trusted text; every probability and back-off weight comes from joins of the count tables on the n-gram,
its context and its suffix.  The model is cut into shards by the byte before the predicted one: whatever a prediction
needs (all its suffixes and contexts) is in one shard, and a task holds one shard of bounded size at a time.

Documents are dealt into folds by their id.  Each fold has a model of the trusted text of all other folds, and every
document, trusted or not, is judged by the model of its fold, which hasn't seen it.  So all trusted documents stand behind
the limits: a document's distance in bits per byte from the median of its language, times the root of its length, must
lie between two quantiles of theirs, and so must the bits of its least likely stretch.  Text that is too predictable (one
phrase again and again) goes as well as noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import pieces, stored, utf8
from .tokens import Encoder

ORDER = 5
#: Bytes of text looked at together; a worker holds about forty times as much.
PIECE = 2 << 20
#: n-grams that a counting task keeps before it passes them on.
MOST_KEPT = 4_000_000
#: Rows of a model shard; 8 bytes and 4 for each fold on an executor.
SHARD_ROWS = 4_000_000
#: Trusted ids that are sent to all executors; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: Folds of documents, each with a model of the others' trusted text.
FOLDS = 5
#: Bytes of the stretch of a document that counts by itself.
STRETCH = 8


def ngrams(body: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte, it and the ``order`` - 1 bytes before it as one number; documents begin after line ends."""
    key = np.zeros(len(body), np.uint64)
    at = np.arange(len(body)) - np.repeat(offsets[:-1], np.diff(offsets))  # place in its document
    wide = body.astype(np.uint64)
    for back in range(order):
        part = np.full(len(body), 10, np.uint64)
        part[back:] = wide[: max(len(body) - back, 0)]
        part[at < back] = 10
        key |= part << np.uint64(8 * back)
    return key


#: Bits of a packed n-gram below its fold.
FOLD_AT = 56


def _count(order: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        Encoder.forget()
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            keys, n = np.concatenate([k for k, _ in kept]), np.concatenate([n for _, n in kept])
            u, at = np.unique(keys, return_inverse=True)
            return u, np.bincount(at, n, len(u)).astype(np.int64)

        def rows(u, n):
            fold, gram = u >> np.uint64(FOLD_AT), u & np.uint64((1 << FOLD_AT) - 1)
            return pa.record_batch({"fold": pa.array(fold.astype(np.int32)), "gram": pa.array(gram.astype(np.int64)), "n": pa.array(n)})

        for batch in pieces(batches, "text", PIECE):
            body, offsets = utf8(batch.column("text"))
            if not len(body):
                continue
            fold = np.repeat(batch.column("fold").to_numpy().astype(np.uint64), np.diff(offsets))
            kept.append(np.unique(ngrams(body, offsets, order) | fold << np.uint64(FOLD_AT), return_counts=True))
            if len(kept) > 8 or sum(len(k) for k, _ in kept) > MOST_KEPT:
                kept = [merged()]
                if len(kept[0][0]) > MOST_KEPT // 2:
                    yield rows(*kept.pop())
        if kept:
            yield rows(*merged())

    return run


def train(trusted: DataFrame, order: int = ORDER, name: str = "kneser-ney", text: str = "text", fold: str | None = None, folds: int = 1) -> DataFrame:
    """The models of ``trusted`` as a stored table: kind ("p" or "backoff"), level, gram, value (log2, one for each model).

    Without ``fold`` there is one model, of all rows; with it one for each number below ``folds``, of the rows of all other
    folds.  They share their counts and joins; an n-gram that a model doesn't have is null there.

    Level k predicts the last byte of a k-gram from the k - 1 bytes before it.  The highest level has counts of
    occurrences, the others counts of different bytes before.  Null and empty texts count nothing.  An empty table gives
    an empty model (every byte then takes 8 bits).
    """
    every = range(folds)
    rows = trusted.select(F.col(text).alias("text"), (F.col(fold) if fold else F.lit(folds)).cast("int").alias("fold")).filter(F.length("text") > 0)
    counted = rows.mapInArrow(_count(order), "fold int, gram long, n long")
    own = [F.sum(F.when(F.col("fold") != f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in every]
    seen = F.expr(" OR ".join(f"n{f} > 0" for f in every))
    levels = {order: stored(counted.groupBy("gram").agg(*own).filter(seen), f"{name}-{order}")}
    for k in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1))
        levels[k] = stored(levels[k + 1].groupBy(suffix.alias("gram")).agg(*[F.count_if(F.col(f"n{f}") > 0).alias(f"n{f}") for f in every]), f"{name}-{k}")
    out, lower = None, None
    for k in range(1, order + 1):
        of = levels[k].agg(*[F.count_if(F.col(f"n{f}") == i) for f in every for i in (1, 2, 3, 4)]).first()
        rows = levels[k].select("*", F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1)).alias("suffix"))
        for f in every:
            n, (one, two, more) = F.col(f"n{f}"), discounts(*of[4 * f : 4 * f + 4])
            rows = rows.withColumn(f"d{f}", F.when(n == 0, 0.0).when(n == 1, one).when(n == 2, two).otherwise(more))
        total = lambda f: F.nullif(F.sum(f"n{f}"), F.lit(0))
        context = rows.groupBy("context").agg(*[total(f).alias(f"total{f}") for f in every], *[(F.sum(f"d{f}") / total(f)).alias(f"backoff{f}") for f in every])
        rows = rows.join(context, "context")
        rows = rows.join(lower, "suffix") if lower is not None else rows.withColumns({f"lower{f}": F.lit(1.0 / 256) for f in every})
        p = [F.when(F.col(f"n{f}") > 0, (F.col(f"n{f}") - F.col(f"d{f}")) / F.col(f"total{f}") + F.col(f"backoff{f}") * F.col(f"lower{f}")).alias(f"p{f}") for f in every]
        level = stored(rows.select("gram", "context", *[f"backoff{f}" for f in every], *p), f"{name}-p{k}")
        logs = lambda c: F.array(*[F.log2(f"{c}{f}").cast("float") for f in every]).alias("value")
        part = level.select(F.lit("p").alias("kind"), F.lit(k).alias("level"), "gram", logs("p")).unionByName(
            level.groupBy("context").agg(*[F.first(f"backoff{f}").alias(f"backoff{f}") for f in every])
            .select(F.lit("backoff").alias("kind"), F.lit(k).alias("level"), F.col("context").alias("gram"), logs("backoff"))
        )
        out = part if out is None else out.unionByName(part)
        lower = level.select(F.col("gram").alias("suffix"), *[F.col(f"p{f}").alias(f"lower{f}") for f in every])
    return stored(out, f"{name}-model")


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more from the number of n-grams with each count; i / 2 where that is undefined."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    return [min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) if a and b else i / 2 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def shards(model: DataFrame, most: int) -> list[tuple[np.ndarray, dict]]:
    """Shards of at most about ``most`` rows: the bytes each answers for, and its broadcast arrays."""
    before = F.when(F.col("level") == 1, -1).when(F.col("kind") == "p", F.shiftright("gram", 8).bitwiseAND(F.lit(255))).otherwise(F.col("gram").bitwiseAND(F.lit(255))).cast("int")
    model = model.withColumn("before", before)
    sizes = {r["before"]: r["count"] for r in model.groupBy("before").count().collect()}  # at most 257 rows
    groups: list[list[int]] = []
    room = 0
    for b in range(256):
        if not groups or room < sizes.get(b, 0):
            groups.append([])
            room = max(most, sizes.get(b, 0))
        groups[-1].append(b)
        room -= sizes.get(b, 0)
    out = []
    for own in groups:
        part = model if len(groups) == 1 else model.filter(F.col("before").isin([-1, *own]))
        got = part.select("kind", "level", "gram", "value").toArrow().combine_chunks()
        values = got.column("value").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(got), -1) if len(got) else None
        arrays = {}
        for kind in ("p", "backoff"):
            for level in np.unique(got.column("level").to_numpy()):
                at = (got.column("kind").to_numpy() == kind) & (got.column("level").to_numpy() == level)
                gram, value = got.column("gram").to_numpy()[at], values[at]
                by = np.argsort(gram)
                arrays[kind, int(level)] = (gram[by], value[by])
        mine = np.zeros(256, bool)
        mine[own] = True
        out.append((mine, model.sparkSession.sparkContext.broadcast(arrays)))
    return out


def _bits(body: np.ndarray, offsets: np.ndarray, mine: np.ndarray, arrays: dict, order: int, fold: np.ndarray) -> np.ndarray:
    """Bits of each byte that the shard answers for under the model of its document's fold; 0 for the other bytes."""
    key = ngrams(body, offsets, order).astype(np.int64)
    bits = np.zeros(len(body))
    left = np.arange(len(body)) if mine.all() else np.flatnonzero(mine[(key >> 8) & 255])
    model = np.repeat(fold.astype(np.int8), np.diff(offsets))
    for level in range(order, 0, -1):
        if not len(left):
            break
        gram = key[left] & ((1 << (8 * level)) - 1)
        found, value = _look_up(arrays.get(("p", level)), gram, model[left])
        bits[left[found]] -= value[found]
        left, gram = left[~found], gram[~found]
        found, value = _look_up(arrays.get(("backoff", level)), gram >> 8, model[left])
        bits[left[found]] -= value[found]
    bits[left] += 8
    return bits


def _look_up(table, keys: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if table is None or not len(table[0]) or not len(keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    value = table[1][at, model]
    return (table[0][at] == keys) & ~np.isnan(value), value


def _sums(bits: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By document: all bits, and those of the ``STRETCH`` bytes in a row that take most."""
    total = np.concatenate([[0.0], np.cumsum(bits)])
    size = np.diff(offsets)
    worst = np.zeros(len(size))
    if len(bits):
        ends = np.minimum(np.arange(len(bits)) + STRETCH, np.repeat(offsets[1:], size))
        worst[size > 0] = np.maximum.reduceat(total[ends] - total[:-1], offsets[:-1][size > 0])
    return total[offsets[1:]] - total[offsets[:-1]], worst


def _score(mine: np.ndarray, arrays, order: int, text: str):
    def run(batches) -> Iterator:
        import pyarrow as pa

        Encoder.forget()
        for batch in pieces(batches, text, PIECE):
            body, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
            fold = batch.column(batch.schema.get_field_index("__fold")).to_numpy()
            bits, worst = _sums(_bits(body, offsets, mine, arrays.value, order, fold), offsets)
            yield pa.record_batch([*batch.columns, pa.array(bits), pa.array(np.diff(offsets)), pa.array(worst)], names=[*batch.schema.names, *SCORES])

    return run


def _parts_of(mine: np.ndarray, arrays, order: int):
    """One shard's bits of each text: which bytes it answers for (a bit each), and the bits of these."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        Encoder.forget()
        for batch in pieces(batches, "text", PIECE):
            body, offsets = utf8(batch.column("text"))
            bits = _bits(body, offsets, mine, arrays.value, order, batch.column("__fold").to_numpy()).astype(np.float32)
            live = [bits[a:b] != 0 for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.record_batch([
                batch.column("__key"), batch.column("__hash"), pa.array(np.diff(offsets)), pa.array([np.packbits(x).tobytes() for x in live], pa.binary()),
                pa.array([bits[a:b][x].tobytes() for a, b, x in zip(offsets[:-1], offsets[1:], live)], pa.binary()),
            ], names=["__key", "__hash", "__bytes", "live", "bits"])

    return run


def _joined(batches) -> Iterator:
    """The sums of each text from what all shards say of it."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for size, parts in zip(batch.column("__bytes").to_pylist(), batch.column("parts").to_pylist()):
            bits = np.zeros(size)
            for part in parts:
                bits[np.unpackbits(np.frombuffer(part["live"], np.uint8), count=size).astype(bool)] += np.frombuffer(part["bits"], np.float32)
            out.append([x[0] for x in _sums(bits, np.array([0, size]))])
        bits, worst = np.array(out).reshape(-1, 2).T
        yield pa.record_batch([*[batch.column(c) for c in ("__key", "__hash")], pa.array(bits), batch.column("__bytes"), pa.array(worst)], names=["__key", "__hash", *SCORES])


SCORES = ("__bits", "__bytes", "__worst")


def entropy(docs: DataFrame, parts: list, order: int = ORDER, key: str = "doc_id", text: str = "text", fold: Column | None = None) -> DataFrame:
    """``docs`` with __bits (of the whole text), __bytes and __worst (bits of the stretch that takes most), under the model
    of the row's ``fold`` (the first one without).  Null and empty texts: 0.

    With one shard the texts stay where they are.  With more, each shard gives the bits of its bytes for each row, and
    what they say of a text meets the rows in one join on key and a hash of the text (repeated rows have equal bits).
    """
    docs = docs.withColumn("__fold", (F.lit(0) if fold is None else fold).cast("int"))
    if len(parts) == 1:
        schema = T.StructType([*docs.schema.fields, T.StructField("__bits", T.DoubleType()), T.StructField("__bytes", T.LongType()), T.StructField("__worst", T.DoubleType())])
        return docs.mapInArrow(_score(*parts[0], order, text), schema).drop("__fold")
    rows = docs.withColumns({"__key": F.coalesce(F.col(key).cast("string"), F.lit("")), "__hash": F.xxhash64(F.col(key), F.col(text))})
    said = None
    for number, part in enumerate(parts):
        narrow = rows.select("__key", "__hash", "__fold", F.col(text).alias("text"))
        one = narrow.mapInArrow(_parts_of(*part, order), "__key string, __hash long, __bytes long, live binary, bits binary").withColumn("part", F.lit(number))
        said = one if said is None else said.unionByName(one)
    once = said.groupBy("__key", "__hash", "part").agg(F.first(F.struct("__bytes", "live", "bits")).alias("x"))
    sums = once.groupBy("__key", "__hash").agg(F.first("x.__bytes").alias("__bytes"), F.collect_list(F.struct("x.live", "x.bits")).alias("parts"))
    sums = sums.mapInArrow(_joined, "__key string, __hash long, __bits double, __bytes long, __worst double")
    return rows.join(sums, ["__key", "__hash"]).drop("__key", "__hash", "__fold")


def trusted_ids(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of which every label says good quality and none says toxic.  A null label trusts nothing."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return labels.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.coalesce(good, F.lit(False))).alias("__good")).filter("__good").select(F.col(key).alias("__id"))


def _distance(bits: Column, size: Column, centre: Column) -> Column:
    return (bits / size - centre) * F.sqrt(size)


def thresholds(trusted: DataFrame, tail: float, margin: float, stretch: tuple[float, float], lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """For each language (null is one), and for all together: median bits a byte, the two limits of the distance and the
    most bits of a stretch.

    The limits are the quantiles ``tail`` and 1 - ``tail`` of the distances, wider by ``margin`` times the median distance
    of all trusted documents from the middle of their language; for the stretch, the quantile 1 - stretch[0] times
    stretch[1].  The margins are the same for a language of any size.
    """
    rows = trusted.filter(F.col("__bytes") > 0).select(F.col(lang).alias("__lang"), *SCORES)
    middle = F.percentile_approx(F.col("__bits") / F.col("__bytes"), 0.5, 10000).alias("__centre")
    own, whole = rows.groupBy("__lang").agg(middle), rows.agg(middle)
    z = _distance(F.col("__bits"), F.col("__bytes"), F.col("__centre")).alias("__z")
    per = stored(rows.join(own.withColumnRenamed("__lang", "__of"), F.col("__lang").eqNullSafe(F.col("__of"))).select("__lang", "__worst", "__centre", z), "distances")
    every = rows.crossJoin(F.broadcast(whole)).select("__worst", "__centre", z)  # one row
    wider = per.agg((margin * F.percentile_approx(F.abs("__z"), 0.5, 10000)).alias("__wider"))

    def limits(df: DataFrame, keys: list[str]) -> DataFrame:
        cut = F.percentile_approx("__z", [tail, 1 - tail], 10000)
        found = df.groupBy(*keys).agg(F.first("__centre").alias("__centre"), cut.alias("__cut"), (F.percentile_approx("__worst", 1 - stretch[0], 10000) * stretch[1]).alias("__most"))
        return found.crossJoin(F.broadcast(wider)).select(*keys, "__centre", (F.col("__cut")[0] - F.col("__wider")).alias("__low"), (F.col("__cut")[1] + F.col("__wider")).alias("__high"), "__most")

    return limits(per, ["__lang"]), limits(every, [])


def quality(
    docs: DataFrame, labels: DataFrame, tail: float = 0.0025, margin: float = 1.0, stretch: tuple[float, float] = (0.005, 1.05), order: int = ORDER, shard_rows: int = SHARD_ROWS,
    key: str = "doc_id", text: str = "text", lang: str = "lang", name: str = "quality",
) -> DataFrame:
    """``docs`` with n_bytes, perplexity (of a byte), lowest, highest (the limits of the perplexity for this language
    and length), stretch, stretch_limit (bits of the least likely ``STRETCH`` bytes, and the most allowed) and keep.

    Null and empty texts have no perplexity and are not kept.  A language without any trusted document takes the limits
    of all languages.  Without trusted documents in two folds or more every text is kept.  Repeated rows are judged alike;
    ties don't matter, the limits belong to what is kept.  Columns of ``docs`` with a name used here (n_bytes, perplexity,
    lowest, highest, stretch, stretch_limit, keep) are replaced; others pass.
    """
    docs = docs.drop("n_bytes", "perplexity", "lowest", "highest", "stretch", "stretch_limit", "keep")
    ids = stored(trusted_ids(labels), f"{name}-ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    fold = lambda c: F.pmod(F.xxhash64(c, F.lit("held out")), F.lit(FOLDS))
    trusted = docs.select(F.col(key).alias("__id"), F.col(text).alias("text"), F.col(lang).alias("lang"), fold(F.col(key)).alias("__of")).join(ids, "__id")
    parts = shards(train(trusted, order, name, fold="__of", folds=FOLDS), shard_rows)
    seen = stored(entropy(trusted, parts, order, "__id", fold=F.col("__of")).select("lang", "__of", *SCORES), f"{name}-trusted")
    if seen.filter("__bytes > 0").select("__of").distinct().count() < 2:
        seen = seen.limit(0)  # its only fold has an empty model
    per, overall = (stored(x, f"{name}-limits") for x in thresholds(seen, tail, margin, stretch))
    per = per.select("__lang", F.struct("__centre", "__low", "__high", "__most").alias("__own"))
    overall = overall.select(F.struct("__centre", "__low", "__high", "__most").alias("__all"))
    scored = entropy(docs, parts, order, key, text, fold(F.col(key)))
    scored = scored.join(per, F.col(lang).eqNullSafe(F.col("__lang")), "left").join(F.broadcast(overall), how="left")  # one row
    limit = F.coalesce("__own", "__all")
    rate = F.col("__bits") / F.nullif(F.col("__bytes"), F.lit(0))
    root = F.sqrt(F.nullif(F.col("__bytes"), F.lit(0)))
    low, high = limit["__centre"] + limit["__low"] / root, limit["__centre"] + limit["__high"] / root
    keep = F.coalesce((rate >= low) & (rate <= high) & (F.col("__worst") <= limit["__most"]), rate.isNotNull())
    return scored.withColumns({
        "n_bytes": F.col("__bytes"), "perplexity": F.pow(F.lit(2.0), rate), "lowest": F.pow(F.lit(2.0), low), "highest": F.pow(F.lit(2.0), high),
        "stretch": F.when(rate.isNotNull(), F.col("__worst")), "stretch_limit": limit["__most"], "keep": keep,
    }).drop(*SCORES, "__lang", "__own", "__all")
