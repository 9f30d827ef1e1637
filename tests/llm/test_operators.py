"""The training-data operators against brute force, on small tables with hard rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.llm import jaccard_join, pii, tagger
from hindcast.llm.common import utf8
from hindcast.llm.components import components
from hindcast.llm.jaccard_join import bands, jaccard_components, near_duplicates
from hindcast.llm.mixing import mix, mix_documents
from hindcast.llm.near_vectors import near_vectors
from hindcast.llm.neighbours import nearest
from hindcast.llm.packing import cut_documents, pack, plan
from hindcast.llm.perplexity import discounts, entropy, quality, shards, train
from hindcast.llm.queries import tokenizer_path
from hindcast.llm.sharding import shard
from hindcast.llm.shingles import set_ids, shingle_sets
from hindcast.llm.substrings import repeated_substrings
from hindcast.llm.suffixes import BlindTrie, anchors, deep_shallow
from hindcast.llm.token_files import ids_crc32, read_token_files, write_token_files
from hindcast.llm.tokens import Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, size long"


def prose(rng, n, words=400):
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 7))) for _ in range(words)]
    return " ".join(rng.choice(vocabulary, n))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, shared passages, null, empty and long texts, repeated rows, a null key, clashing columns."""
    rng = np.random.default_rng(4)
    passage = prose(rng, 60)
    rows = []
    for i in range(60):
        text = prose(rng, int(rng.integers(1, 160)))
        if i % 7 == 0:
            text = text + "\n" + passage
        rows.append([i, text])
    base = prose(rng, 150)
    for i in range(60, 90):  # near copies with a few words changed
        words = base.split()
        for _ in range(int(rng.integers(0, 7))):
            words[rng.integers(0, len(words))] = "x" + str(rng.integers(0, 50))
        rows.append([i, " ".join(words)])
    rows += [[90, rows[5][1]], [91, rows[5][1]], [92, None], [93, ""], [94, "  \n"], [95, prose(rng, 9000)], [96, "One TWO three"], [97, "one two THREE"], [5, rows[5][1]], [None, rows[6][1]]]
    rows += [[98, "é" * 70 + " ab"], [99, "a" * 300], [100, "a" * 300 + "b"]]
    full = [(i, t, ["en", "fr", None][k % 3], ["s1", "s2", "s3", None][k % 4] if k % 3 else "s1", len(t or ""), 7, 7) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS).repartition(5).persist(), full


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, width):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if 0 < len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def groups(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t, *_ in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), 10**9))
    return sorted(((-1 if i is None else i), len(s), least.get(find(k), -1) if s else (-1 if i is None else i)) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_jaccard_components(docs, none, width, percent):
    df, rows = docs
    got = sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in jaccard_components(df, width, percent).collect())
    assert got == groups(rows, width, percent)
    assert jaccard_components(none, width, percent).count() == 0


def test_jaccard_of_blocks(docs, monkeypatch):
    import hindcast.llm.jaccard_join as J

    monkeypatch.setattr(J, "BLOCK_SETS", 4)
    df, rows = docs
    got = sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in jaccard_components(df, 4, 85).collect())
    assert got == groups(rows, 4, 85)


def test_bands_cover_linked_sizes():
    low, k = bands(80, 5000)
    for a in range(1, 2000, 7):
        for b in range(a, a * 100 // 80 + 1):
            i, j = (int(np.searchsorted(low, x, side="right")) - 1 for x in (a, b))
            assert j - i <= 1
            assert k[(i + 1) if i == j else j] >= (20 * (a + b)) // 180


def test_near_duplicates_keep_one_of_each_group(docs, none):
    df, rows = docs
    found = {(-1 if i is None else i): c for i, _, c in groups(rows, 5, 80)}
    kept = [r[0] for r in near_duplicates(df).filter("keep").select("doc_id").collect()]
    assert sorted(k for k in kept if k is not None) == sorted({c for i, c in found.items() if i >= 0})
    assert near_duplicates(none).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    df, rows = docs
    path, vocabulary = str(tmp_path / "ids"), tokenizer_path("byte_bpe_50k.json")
    write_token_files(df, path, vocabulary, files=3)
    got = read_token_files(spark, path).collect()
    t = Tokenizer.from_file(vocabulary)
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for _, x, *_ in rows]
    assert sorted(map(tuple, (r["ids"] for r in got))) == sorted(map(tuple, want))
    got.sort(key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids)
    crc = read_token_files(spark, path).mapInArrow(ids_crc32, "doc_id long, start long, n_tokens long, ids_crc32 long").collect()
    assert {(r["start"], r["ids_crc32"]) for r in crc} == {(r["start"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in got}
    one = read_token_files(spark, path, [95]).collect()
    assert len(one) == 1 and one[0]["n_tokens"] == len(next(w for w, r in zip(want, rows) if r[0] == 95))
    write_token_files(none, str(tmp_path / "none"), vocabulary)
    assert read_token_files(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("name,mode", [("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "words")])
def test_encoder_gives_the_ids_of_whole_texts(name, mode):
    texts = ["a  b\n\n c  ", "  x", "don't  stop", " \t\n", "a\x1cb !\x1c", "", None, "x" * 200 + " y  z w　 q", "<|endoftext|> hi", "é" * 70 + "\n\n", "A B 1234 c", "tail \n", "  lead  two"] * 2
    e = Encoder(tokenizer_path(name), mode)
    ids, width = e.encode(texts)
    got = np.split(ids, np.cumsum(width)[:-1])
    for t, g in zip(texts, got):
        assert list(g) == e.tokenizer.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("name,mode", [("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "words")])
def test_a_word_is_learned_once_whatever_sign_follows(name, mode):
    """Chunks end between a letter and an ASCII sign, never where ids may reach across: not after marks, U+0130 or other spaces."""
    signs = [",", ".", "'s x", ".%%%", "\n\n x", " x", "-y", "\u0301,", "\u0338", "'", "''re", "_a"]
    words = ["weorld", "né", "İ", "ŁĆ", "жук", "½", "x²", "ª", "中", "\u00a0", "\u2009", "\u3000", "\u1ea1", "…", "é\u0307", "Ⓐ", "\x1c", "7"]
    texts = [f"a {w}{s}" for w in words for s in signs] + [f"{w}{s}" for w in words for s in signs]
    e = Encoder(tokenizer_path(name), mode)
    ids, width = e.encode(texts)
    for t, g in zip(texts, np.split(ids, np.cumsum(width)[:-1])):
        assert list(g) == e.tokenizer.encode(t, add_special_tokens=False).ids, t
    assert {c for c in e.known if c.startswith(" weorld") and c.isascii()} == {" weorld"}
    assert [x.tolist() for x in Encoder(tokenizer_path(name), mode).encode([None, ""])] == [[], [0, 0]]


def test_packets_name_a_set_once_in_a_bucket():
    """What travels is five bytes a signature and twelve for each set and bucket; all signatures arrive."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = [prose(rng, 300, 4000) for _ in range(20)]
    batch = pa.record_batch({"text": pa.array(texts)})
    (out,) = jaccard_join._packets(4, 85, 3)(iter([batch]))
    hashed, at = shingle_sets(*utf8(batch.column("text")), 4)
    sig, own = jaccard_join.signatures(hashed, at, 85)
    got = []
    for bucket, low, count, ids in zip(*(c.to_pylist() for c in out.columns)):
        n = np.frombuffer(count, np.uint32)
        assert len(ids) == 8 * len(n) <= 8 * 20 and 5 * n.sum() == len(low)
        whose = np.repeat(np.frombuffer(ids, np.int64), n)
        got += [(bucket, low[5 * k : 5 * k + 5], w) for k, w in enumerate(whose)]
    names = set_ids(hashed, at)
    assert sorted(got) == sorted(((int(s) >> 32) * 3 >> 32, int(s).to_bytes(8, "little")[:5], names[o]) for s, o in zip(sig, own))


def test_removed_substrings(docs, none):
    df, rows = docs
    first, want = {}, []
    key = lambda r: 10**9 if r[0] is None else r[0]
    for r in sorted(rows, key=key):
        b = (r[1] or "").encode()
        for q in range(len(b) - 49):
            first.setdefault(b[q : q + 50], key(r))
    for r in rows:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for q in range(len(b) - 49):
            if first[b[q : q + 50]] < key(r):
                gone[q : q + 50] = b"\1" * 50
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        want.append((key(r), len(b), sum(gone), len(spans), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest(), spans))
    got = [(10**9 if r[0] is None else r[0], *r[1:5], [(s["start"], s["end"]) for s in r[5]]) for r in repeated_substrings(df).collect()]
    assert sorted(got) == sorted(want)
    assert repeated_substrings(none).count() == 0


def test_deep_shallow_order_and_classes():
    rng = np.random.default_rng(2)
    for alphabet in (b"ab", b"abcdefgh"):
        body = bytes(rng.choice(list(alphabet), 2500).astype(np.uint8))
        body += body[100:900] + body[:60] * 3
        starts = np.arange(len(body) - 50)
        order, group = deep_shallow(np.frombuffer(body, np.uint8), starts, 50)
        got = [body[i : i + 50] for i in order]
        assert got == sorted(body[i : i + 50] for i in starts)
        assert all((got[i] == got[i - 1]) == (group[i] == group[i - 1]) for i in range(1, len(got)))
    strings = [b"abcd", b"abca", b"zzzz", b"abba", b"aaaa"]
    assert [strings[i] for i in BlindTrie(strings).order()] == sorted(strings)


def test_anchors_cover_every_window_and_depend_on_it_alone():
    rng = np.random.default_rng(5)
    body = bytes(rng.choice(list(b"abc"), 3000).astype(np.uint8))
    body = np.frombuffer(body + body[200:800], np.uint8)
    offsets = np.array([0, 1000, 1000, 2500, len(body)])
    h, first, last, doc = anchors(body, offsets, 50)
    seen, of = [], {}
    for k in range(len(h)):
        for p in range(first[k], last[k] + 1):
            seen.append(p)
            assert of.setdefault(body[p : p + 50].tobytes(), h[k]) == h[k]
            assert offsets[doc[k]] <= p and p + 50 <= offsets[doc[k] + 1]
    assert seen == [p for a, b in zip(offsets, offsets[1:]) for p in range(a, b - 49)]


def test_packing(docs, none):
    df, rows = docs
    vocabulary = tokenizer_path("word_bpe_49k.json")
    found = pack(cut_documents(df, vocabulary, capacity=64), 64).collect()
    want = collections.Counter()
    e = Encoder(vocabulary, "words")
    for i, t, *_ in rows:
        ids = [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 64)):
            want[(i, p, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes()))] += 1
    assert collections.Counter((r[0], r[1], r[2], r[3], r[4]) for r in found) == want
    fill = collections.defaultdict(list)
    for r in found:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in fill.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(fill) <= math.ceil(sum(r["length"] for r in found) / 64) * 1.05 + 1
    assert pack(cut_documents(none, vocabulary)).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 200, 3000)
    gaps = []
    for s in sorted(sizes.tolist(), reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            g = min(fits)
            gaps.remove(g)
        else:
            g = 200
        gaps.append(g - s)
    runs = plan(dict(collections.Counter(sizes.tolist())), 200)
    assert max(first + n for _, _, n, first, _ in runs) == len(gaps)


def test_sharding(docs, none):
    df, rows = docs
    got = shard(df, [1.0] * 6, grown=[1.0] * 7).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 6)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({(r["doc_id"], r["shard"]) for r in got}) == len({r["doc_id"] for r in got})
    assert shard(none, [1.0] * 3).count() == 0


def test_rendezvous_shares_follow_the_weights(spark):
    n = spark.range(20000).withColumn("text", F.lit("x"))
    share = {r["shard"]: r["count"] / 20000 for r in shard(n, [3.0, 1.0, 0.0, 2.0], key="id").groupBy("shard").count().collect()}
    assert set(share) == {0, 1, 3} and abs(share[0] - 0.5) < 0.02 and abs(share[3] - 1 / 3) < 0.02


def test_mix(docs, none):
    df, rows = docs
    got = mix(df).collect()
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    weights = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate([*sorted(s for s in size if s is not None), None])}
    target, left, total = {}, set(size), 1.5 * sum(size.values())
    while left:  # reshare what is above the limit until none is
        rest = total - sum(target.values())
        over = [s for s in left if rest * weights[s] / sum(weights[x] for x in left) >= 2 * size[s]]
        for s in over or list(left):
            target[s] = 2.0 * size[s] if over else rest * weights[s] / sum(weights[x] for x in left)
        left -= set(target)
    taken, longest = collections.Counter(), collections.Counter()
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == size[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-6 for s in size)
    assert sorted(map(str, got)) == sorted(map(str, mix(df.repartition(3)).collect()))
    out = mix_documents(df)
    assert out.columns == df.columns
    copies = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    want = collections.Counter()
    for r in got:
        want[r["doc_id"], r["size"]] += r["copies"] if r["size"] else 0
    have = collections.Counter()
    for (i, t), n in copies.items():
        have[i, len(re.findall(r"[^\x20\x09-\x0D]+", t))] += n
    assert have == +want
    assert mix(none).count() == 0 and mix_documents(none).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    x[40:60] = x[7] + 0.15 * rng.standard_normal((20, 16))
    x[60] = x[61] = x[62]
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [None] * 16, 0), (304, [], 1), (305, [1.0, 2.0], 1), (61, x[62].tolist(), 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).persist(), rows


def good(v):
    return v and len(v) == 16 and all(c is not None and math.isfinite(c) for c in v) and any(v)


@pytest.mark.parametrize("block", [2000, 5])
def test_near_vectors(vectors, monkeypatch, block):
    import hindcast.llm.near_vectors as N

    monkeypatch.setattr(N, "BLOCK", block)
    df, rows = vectors
    x = np.array([r[1] if good(r[1]) else [0.0] * 16 for r in rows], np.float64)
    norm = np.linalg.norm(x, axis=1)
    y = x / np.where(norm > 0, norm, 1)[:, None]
    link = (y @ y.T >= 0.9) & ~np.eye(len(rows), dtype=bool)
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in zip(*np.nonzero(link)):
        root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        least[find(k)] = min(r[0], least.get(find(k), 10**9))
    want = sorted((r[0], int(link[k].sum()), least[find(k)], r[0] == least[find(k)]) for k, r in enumerate(rows))
    assert sorted(map(tuple, near_vectors(df).collect())) == want
    assert near_vectors(df.limit(0)).count() == 0


def test_nearest(vectors):
    df, rows = vectors
    got = collections.defaultdict(list)
    for r in nearest(df, F.col("vec_id") % 100 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    live = {r[0]: np.array(r[1], np.float64) for r in rows if good(r[1])}
    hit = 0
    for q in (0, 100, 200):
        want = sorted((float(np.sqrt(((v - live[q]) ** 2).sum())), i) for i, v in live.items() if i != q)[:5]
        hit += len({i for _, i in want} & {i for i, _ in got[q]})
        assert all(abs(s - np.linalg.norm(live[i] - live[q])) < 1e-9 for i, s in got[q])
        assert [s for _, s in got[q]] == sorted(s for _, s in got[q])
    assert set(got) == {0, 100, 200} and hit >= 14
    assert nearest(df.limit(0), F.lit(True)).count() == 0


def kneser_ney(texts, order):
    """The definition, with dictionaries."""
    counts = {order: collections.Counter()}
    for t in texts:
        b = b"\n" * (order - 1) + t.encode()
        counts[order].update(b[i : i + order] for i in range(len(b) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    d = {k: discounts(*(sum(n == i for n in counts[k].values()) for i in (1, 2, 3, 4))) for k in counts}
    total, cut = collections.Counter(), collections.Counter()
    for k in counts:
        for g, n in counts[k].items():
            total[k, g[:-1]] += n
            cut[k, g[:-1]] += d[k][min(n, 3) - 1]

    def p(g):
        if not g:
            return 1 / 256
        k, c = len(g), g[:-1]
        if not total[k, c]:
            return p(g[1:])
        n = counts[k][g]
        return (max(n - d[k][min(n, 3) - 1], 0) if n else 0) / total[k, c] + cut[k, c] / total[k, c] * p(g[1:])

    return lambda t: -sum(math.log2(p((b"\n" * (order - 1) + t.encode())[i : i + order])) for i in range(len(t.encode())))


@pytest.mark.parametrize("rows", [10**6, 100])
def test_perplexity_matches_the_definition(spark, docs, rows):
    df, all_rows = docs
    texts = [r[1] for r in all_rows if r[1]][:40]
    trusted = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string")
    parts = shards(train(trusted, 4), rows)
    assert (len(parts) > 1) == (rows == 100)
    bits = kneser_ney(texts, 4)
    for r in entropy(df, parts, 4).select("text", "__bits", "__bytes").collect():
        assert r["__bytes"] == len((r["text"] or "").encode())
        if r["__bytes"] < 3000:
            assert abs(r["__bits"] - bits(r["text"] or "")) < 1e-3 * (1 + r["__bytes"])


def test_quality_keeps_clean_text_and_drops_noise(spark):
    rng = np.random.default_rng(6)
    clean = [prose(rng, int(rng.integers(40, 120))) for _ in range(120)]
    noise = ["".join(chr(c) for c in rng.integers(33, 126, 300)) for _ in range(10)]
    rows = [(i, t, ["en", None][i % 2]) for i, t in enumerate(clean + noise)] + [(500, None, "en"), (501, "", "xx"), (3, clean[3], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("keep", F.lit("old"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)] + [(125, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = quality(df, labels, order=3).select("doc_id", "keep").collect()
    assert len(got) == len(rows)
    kept = {r["doc_id"] for r in got if r["keep"]}
    assert len(kept & set(range(120))) >= 110 and not kept & set(range(120, 130)) and not kept & {500, 501}
    assert quality(df.limit(0), labels).count() == 0
    assert quality(df, labels.limit(0)).filter("keep").count() == len(rows) - 2


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            s, digits = m.group(), re.sub("[^0-9]", "", m.group())
            if k == 1 and any(int(x) > 255 for x in s.split(".")):
                continue
            if k == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    rng = np.random.default_rng(9)
    pieces = ["a@b.c", "@", "x@y", "a@b.c@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "++", "+1", "é", " ", ".", "-", "%", "x_y@z-1.org", "..@..", "12", "3"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces, rng.integers(1, 9)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_gradient_of_the_tagger():
    rng = np.random.default_rng(0)
    p = tagger.fresh(1, 4, 3)
    code, tags = rng.integers(32, 120, (3, 7)), rng.integers(0, tagger.TAGS, (3, 7))
    _, g = tagger.loss_and_gradient(p, code, tags)
    for k in p:
        i = tuple(int(rng.integers(0, s)) for s in p[k].shape)
        i = (int(code[0, 0]), i[1]) if k == "embed" else i
        old = p[k][i]
        p[k][i] = old + 1e-5
        up = tagger.loss_and_gradient(p, code, tags)[0]
        p[k][i] = old - 1e-5
        down = tagger.loss_and_gradient(p, code, tags)[0]
        p[k][i] = old
        assert abs((up - down) / 2e-5 - g[k][i]) < 1e-7


@pytest.fixture(scope="module")
def model():
    return tagger.train(*pii.examples([prose(np.random.default_rng(1), 400)] * 3, 2000, 5), steps=200)


def test_tagger_on_held_out_examples(model):
    code, tags = pii.examples([prose(np.random.default_rng(2), 400)], 300, 77)
    got, _ = tagger.decode(model, code)
    want, found = ([set(tagger.spans_of(x)) for x in y] for y in (tags, got))
    right = sum(len(a & b) for a, b in zip(want, found))
    assert right >= 0.75 * sum(map(len, want)) and right >= 0.75 * sum(map(len, found))


def test_windows_without_a_sign_change_nothing(model):
    rng = np.random.default_rng(3)
    text = prose(rng, 200) + " call 415-555-2671 now " + prose(rng, 150) + " mail joe.doe@site.org " + prose(rng, 60)
    every = tagger.find(model, [text], re.compile(r"(?s)."))[0]
    some = tagger.find(model, [text], re.compile(r"[0-9@]"))[0]
    fine = lambda spans: [s for s in spans if pii.accepted(s[0], text, s[1], s[2])]
    assert fine(every) == fine(some)


def test_spans_and_redaction(spark, docs, none, model):
    df, rows = docs
    extra = spark.createDataFrame([(200, "write a.b@c.org or +1 (415) 555-2671, ip 10.0.0.1"), (201, None), (201, None), (None, "")], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["base"]] for r in pii.find_spans(extra, model).collect()}
    assert got[200] == [(s, tagger.KINDS[k], e) for s, k, e in plain_spans("write a.b@c.org or +1 (415) 555-2671, ip 10.0.0.1")] and got[201] == [] and got[None] == []
    out = {r["doc_id"]: r["text"] for r in pii.redact(extra, model).collect()}
    assert out[200] == "write <email> or <phone>, ip <ip>" and out[201] is None and out[None] == ""
    assert pii.redact(df, model).count() == len(rows) and pii.redact(df, model).columns == df.columns
    assert pii.find_spans(none, model).count() == 0
