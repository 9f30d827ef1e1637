"""Vector codes, hard negatives and chunk reuse against brute force, on small tables with hard rows."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.llm import chunk_reuse, hard_negatives as hn
from hindcast.llm.chunk_reuse import chunk_ends, decode_documents, encode_documents, layout
from hindcast.llm.codes import Codebook, vector_codes, whole
from hindcast.llm.common import spread_join, stored
from hindcast.llm.queries import tokenizer_path
from hindcast.llm.tokens import Encoder

VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, block long, anchor_id long"


def vectors(n, d, seed, groups=4):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((groups, d))
    x = centre[rng.integers(0, groups, n)] + 0.2 * rng.standard_normal((n, d))
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


@pytest.fixture(scope="module")
def hard(spark):
    """Clusters, a large group of equal vectors, null, empty, short, zero and non-finite vectors, null and repeated ids."""
    x = vectors(160, 16, 1)
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in x[i]], int(rng.integers(0, 4))) for i in range(160)]
    rows += [(1000 + i, rows[3][1], int(rng.integers(0, 3))) for i in range(60)]  # ties
    rows += [(2000, None, 1), (2001, [], 1), (2002, [1.0] * 8, 1), (2003, [0.0] * 16, 1), (2004, [math.nan] * 16, 1), (2005, [math.inf] + [0.0] * 15, 1), (2006, [None] + [0.5] * 15, 1)]
    rows += [(2100, rows[7][1], None), (2200, rows[9][1], 2)]
    return spark.createDataFrame([(*r, "x", 7, 7, 7) for r in rows], VECTORS).repartition(5).persist(), rows


def usable(rows, d):
    return [r for r in rows if r[1] is not None and len(r[1]) == d and all(v is not None and math.isfinite(v) for v in r[1])]


# --- vector codes -----------------------------------------------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v: [tuple(math.floor(scale * x) for x in v[p * len(v) // parts : (p + 1) * len(v) // parts]) for p in range(parts)]
    books = [[cut(r[1])[p] for r in order[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, p: min(range(len(books[p])), key=lambda e: (dist(x, books[p][e]), e))
    for _ in range(rounds):
        held = [[[] for _ in b] for b in books]
        for r in rows:
            for p, x in enumerate(cut(r[1])):
                held[p][near(x, p)].append(x)
        books = [[tuple(sum(c) // len(h) for c in zip(*h)) if h else e for e, h in zip(b, hs)] for b, hs in zip(books, held)]
    out = []
    for r in rows:
        code = [near(x, p) for p, x in enumerate(cut(r[1]))]
        out.append((r[0], r[2], "".join(f"{c:02x}" for c in code), sum(dist(x, books[p][code[p]]) for p, x in enumerate(cut(r[1])))))
    of = {}
    for r in out:
        of[r[1]] = of.get(r[1], 0) + r[3]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, code, error, of[label], sha) for i, label, code, error in out), key=str)


def coded(df, **kw):
    return sorted((tuple(r) for r in vector_codes(df, **kw).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_vector_codes_are_those_of_brute_force(hard):
    df, rows = hard
    assert coded(df) == brute_codes(usable(rows, 16))


def test_vector_codes_of_few_repeated_and_null_ids(spark, hard):
    _, rows = hard
    few = [(5, rows[0][1], 1), (5, rows[1][1], 1), (5, rows[0][1], 1), (None, rows[2][1], None), (None, rows[4][1], 2)]
    df = spark.createDataFrame([(*r, "x", 7, 7, 7) for r in few], VECTORS)
    assert coded(df) == brute_codes(few)
    assert coded(df, entries=2) == brute_codes(few, entries=2)
    assert vector_codes(df.limit(0)).count() == 0
    assert vector_codes(spark.createDataFrame([(1, [1.0, 2.0], 1, "x", 7, 7, 7)], VECTORS)).count() == 0  # eight parts don't fit


def test_vector_codes_of_large_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in rng.standard_normal(8) * 3e5], 1) for i in range(40)]
    assert coded(spark.createDataFrame([(*r, "x", 7, 7, 7) for r in rows], VECTORS)) == brute_codes(rows)
    assert whole(np.array([[1e300]]), 4096).dtype == object and whole(np.array([[1.7e308]]), 4096)[0, 0] == int(1.7e308) * 4096
    huge = spark.createDataFrame([(1, [3e38] * 8, 1, "x", 7, 7, 7), (2, [-3e38] * 8, 1, "x", 7, 7, 7)], VECTORS)
    assert [r["error"] for r in vector_codes(huge, entries=1).collect()] == [None, None]


def test_orchard_search_finds_the_nearest_and_the_lower_of_ties():
    rng = np.random.default_rng(5)
    for _ in range(30):
        e, x = rng.integers(-4, 5, (rng.integers(1, 17), 2)), rng.integers(-5, 6, (200, 2))
        far = ((x[:, None] - e[None]) ** 2).sum(2)
        own, best = Codebook(e).nearest(x, rng.integers(0, len(e), len(x)))
        assert (own == far.argmin(1)).all() and (best == far.min(1)).all()


def test_spread_join_of_hot_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr("hindcast.llm.common.HOT_PART", 4)
    rows = stored(spark.createDataFrame([(i, k) for i, k in enumerate([1] * 50 + [None] * 40 + [2] * 5 + [3])], "i int, k int"), "rows")
    side = stored(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("s")), "side")
    total = {}
    for r in rows.collect():
        total[r["k"]] = total.get(r["k"], 0) + r["i"]
    got = spread_join(rows, side, ["k"], "n").collect()
    assert sorted(tuple(r) for r in got if r["k"] is not None) == sorted((r["i"], r["k"], total[r["k"]]) for r in rows.collect() if r["k"] is not None)
    assert sorted((r["i"], r["s"]) for r in got if r["k"] is None) == [(i, total[None]) for i in range(50, 90)]


# --- hard negatives ---------------------------------------------------------------------------------------------------


def brute_negatives(rows, every, positives=5, negatives=5):
    rows = [r for r in rows if r[0] is not None and r[2] is not None]
    one = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        one.setdefault(r[0], r)
    rows = [(i, np.floor(256 * np.array(x, np.float64)).astype(np.int64), l) for i, x, l in one.values()]
    out = []
    for i, x, l in rows:
        if i % every:
            continue
        score = sorted((-int(x @ y), j, m) for j, y, m in rows if j != i)
        for s, j, _ in [r for r in score if r[2] == l][:positives]:
            some = [r for r in score if r[2] != l and 80 * -s <= 100 * -r[0] <= 100 * -s][:negatives]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(some)]
    return sorted(out)


def mined(df, every, **kw):
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % every == 0, **kw).collect())


@pytest.mark.parametrize("block", [7, 1024])
def test_hard_negatives_are_those_of_brute_force(hard, monkeypatch, block):
    df, rows = hard
    monkeypatch.setattr(hn, "BLOCK", block)  # tasks of this machine are forked from it
    monkeypatch.setattr(hn, "TILE", 10)
    want = brute_negatives(usable(rows, 16), 5)
    assert want and mined(df, 5) == want
    assert mined(df, 5, positives=2, negatives=1) == brute_negatives(usable(rows, 16), 5, 2, 1)


def test_hard_negatives_of_repeated_ids_and_empty_tables(spark, hard):
    _, rows = hard
    more = rows[:50] + [(10, rows[2][1], 3), (10, rows[10][1], rows[10][2]), (None, rows[3][1], 1), (20, rows[20][1], rows[20][2])]
    df = spark.createDataFrame([(*r, "x", 7, 7, 7) for r in more], VECTORS)
    assert mined(df, 5) == brute_negatives(usable(more, 16), 5)
    assert mined(df.limit(0), 5) == [] and mined(df.filter("vec_id % 5 <> 0"), 5) == []


def test_zone_bounds_hold_and_leave_blocks_out():
    rng = np.random.default_rng(6)
    a, x = rng.integers(-200, 200, (30, 6)).astype(float), rng.integers(-200, 200, (50, 6)).astype(float)
    least, most = hn.bounds(a, x.min(0)[None], x.max(0)[None])
    score = hn.products(a, x)
    assert (least <= score).all() and (score <= most).all()
    one = hn.bounds(a, x[:1], x[:1])  # a block of one row is known exactly
    assert (one[0][:, 0] == score[:, 0]).all() and (one[1][:, 0] == score[:, 0]).all()
    with pytest.raises(ArithmeticError):
        hn.products(np.full((1, 4), 2.0**40), np.full((1, 4), 2.0**40))


def test_zone_maps_prune_blocks_of_clustered_vectors(spark, monkeypatch, tmp_path):
    """Clusters lie in blocks of their own along the curve, so most of them need not be read."""
    monkeypatch.setattr(hn, "BLOCK", 50)
    seen = []
    keep = hn.stored
    monkeypatch.setattr(hn, "stored", lambda df, name: seen.append((name, keep(df, name))) or seen[-1][1])
    x = vectors(4000, 8, 9, groups=20) * np.float32(1)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(i % 3)) for i in range(len(x))], "vec_id long, embedding array<float>, label int")
    rows = [(i, [float(v) for v in x[i]], int(i % 3)) for i in range(len(x))]
    monkeypatch.setattr(hn, "TILE", 1)
    assert mined(df, 1000) == brute_negatives(rows, 1000)
    of = dict(seen)
    blocks, tiles = of["hard-negatives-blocks"].count(), of["hard-negatives-positives-needed"].select("tile").distinct().count()
    assert of["hard-negatives-positives-needed"].count() < 0.5 * blocks * tiles


def test_hilbert_curve_visits_every_cell_and_moves_by_one():
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        place = hn.hilbert(cells, bits)
        path = cells[np.argsort(place)]
        assert sorted(place) == list(range(len(cells)))
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# --- chunk reuse ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnop") + ["é", "ß", "日", "'s", "9", "!", "İ", "é", "A"]
    prose = lambda n: "".join(x + rng.choice([" ", " ", " ", "\n", ", ", "  ", "\t"]) for x in ("".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(n)))
    passage = prose(700)
    out = [prose(int(rng.integers(1, 900))) for _ in range(25)]
    out += [prose(200) + passage + prose(200) for _ in range(12)] + [passage] * 6
    out += [None, "", " ", "\n\n", "a", "x" * 20_000, "日本語" * 4000, "".join(rng.choice(letters, 9000)), passage * 8, "don't " * 3000]
    out += ["a <|endoftext|> b", passage[:900] + "<|startoftext|>" + passage[900:], "\x1c \x1d x\x1fy" + passage[:2000], "  z " * 1500]
    return out


def test_chunks_are_cut_by_content(texts):
    body = np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len((t or "").encode()) for t in texts])])
    raw = body.tobytes()
    cut = [[raw[a:b] for a, b in zip([at, *ends], ends)] for at, ends in zip(offsets.tolist(), chunk_ends(body, offsets))]
    assert [b"".join(c).decode() for c in cut] == [t or "" for t in texts]
    assert all(len(c) <= chunk_reuse.MOST and c.decode() for d in cut for c in d)
    assert all(len(c) >= chunk_reuse.LEAST for d in cut for c in d[:-1] if len(c) != chunk_reuse.MOST and len(c) > chunk_reuse.MOST - 3 or len(c) >= chunk_reuse.LEAST)
    inside = set(cut[25]) & set(cut[26])  # two texts around one passage share chunks
    assert inside and sum(map(len, inside)) > 1500


def test_layout_covers_the_text(texts):
    for text in [t for t in texts if t]:
        body = np.frombuffer(text.encode(), np.uint8)
        raw = body.tobytes()
        (ends,) = chunk_ends(body, np.array([0, len(body)]))
        chunks = [raw[a:b].decode() for a, b in zip([0, *ends], ends)]
        for words in (1, 2, 8, 64):
            parts = layout(chunks, words)
            assert "".join(p[0] if isinstance(p[0], str) else chunks[p[0]][len(p[1]) : len(chunks[p[0]]) - len(p[2])] for p in parts) == text


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    out = []
    for x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        out.append((ids, t.decode(ids, skip_special_tokens=False)))
    return out


@pytest.mark.parametrize("broadcast", ["67108864", "0"])
def test_ids_and_texts_are_those_of_the_library(spark, texts, broadcast):
    path = tokenizer_path("word_bpe_49k.json")
    rows = [(i, t, i, 0, "x") for i, t in enumerate(texts)] + [(3, texts[3], 7, 0, "x"), (None, texts[27], 7, 0, "x"), (None, None, 7, 0, "x"), (26, texts[26], 1, 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid long, seq int, digest string").repartition(4)
    spark.conf.set("spark.hindcast.broadcastBytes", broadcast)
    try:
        got = decode_documents(encode_documents(df, path), path).collect()
        both = encode_documents(df, path, decoded=True).collect()
    finally:
        spark.conf.unset("spark.hindcast.broadcastBytes")
    want = [(r[0], *w) for r, w in zip(rows, library([r[1] for r in rows]))]
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got), key=str) == sorted(want, key=str)
    assert sorted((tuple(r) for r in both), key=str) == sorted(want, key=str)
    assert decode_documents(encode_documents(df.limit(0), path), path).count() == 0
    assert [r["decoded"] for r in decode_documents(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), path).collect()] == [""]


def test_a_shared_chunk_is_encoded_once(spark, texts, monkeypatch):
    path = tokenizer_path("word_bpe_49k.json")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).persist()
    seen = {}
    keep = chunk_reuse.stored
    monkeypatch.setattr(chunk_reuse, "stored", lambda f, name: seen.setdefault(name, keep(f, name)))
    encode_documents(df, path).count()
    shared = seen["chunk-reuse-shared"]
    assert shared.count() > 0 and seen["chunk-reuse-chunks"].groupBy("digest").count().filter("count > 1").count() == shared.count()
    ready = seen["chunk-reuse-ready"]
    assert ready.count() == ready.select("digest").distinct().count() and ready.count() > 0


def test_windows_that_do_not_agree_are_doubled():
    """A window whose outer ids differ from the chunk's is refused, so the caller widens it."""
    batch = chunk_reuse._Batch(Encoder.of(tokenizer_path("word_bpe_49k.json"), "words", 1000))
    chunks = ["one two three fo", "ur five six"]
    for words in (1, 2):  # with one word on each side, the outer word is the one that is cut
        plan = chunk_reuse._planned(batch, chunks, [False, False], words)
        batch.encode()
        parts = chunk_reuse._joined(batch, plan)
        assert (parts is None) == (words == 1)
    assert np.concatenate(parts).tolist() == library(["".join(chunks)])[0][0]
