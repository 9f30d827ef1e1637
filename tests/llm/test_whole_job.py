"""Places where an operator once did less than the whole job."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.llm import perplexity as P, tagger
from hindcast.llm.jaccard_join import jaccard_components
from hindcast.llm.neighbours import nearest
from hindcast.llm.queries import tokenizer_path
from hindcast.llm.tokens import Encoder

from .test_operators import docs, groups, kneser_ney, none, prose, shingles  # noqa: F401


def test_models_of_folds_leave_out_their_own(spark, docs):
    texts = [r[1] for r in docs[1] if r[1] and len(r[1]) < 3000][:40]
    rows = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts)], "doc_id long, text string, of int")
    model = P.train(rows, 4, fold="of", folds=3)
    want = [kneser_ney([t for i, t in enumerate(texts) if i % 3 != f], 4) for f in range(3)]
    whole = None
    for most in (10**6, 100):
        got = {r["doc_id"]: r for r in P.entropy(rows, P.shards(model, most), 4, fold=F.col("of")).collect()}
        for i, t in enumerate(texts):
            assert abs(got[i]["__bits"] - want[i % 3](t)) < 1e-3 * (1 + len(t))
            whole = whole or got
            assert abs(got[i]["__worst"] - whole[i]["__worst"]) < 1e-3


def test_limits_are_those_of_the_language_at_every_size(spark):
    rng = np.random.default_rng(3)
    rows = [(lang, float(b * n), n, float(w)) for lang, size in (("en", 90), ("xx", 7), (None, 5)) for n, b, w in zip(rng.integers(200, 900, size), rng.normal(2 if lang == "en" else 5, 0.1, size), rng.normal(40, 3, size))]
    schema = "lang string, __bits double, __bytes long, __worst double"
    rows = [(lang, bits, int(n), w) for lang, bits, n, w in rows]
    one, many = (P.thresholds(spark.createDataFrame(rows * k, schema), 0.001, 1.0, (0.001, 1.05))[0].collect() for k in (1, 9))
    key = lambda found: {r["__lang"]: tuple(r)[1:] for r in found}
    assert set(key(one)) == {"en", "xx", None} and key(one) == key(many)
    assert abs(key(one)["xx"][0] - 5) < 0.3 and abs(key(one)["en"][0] - 2) < 0.1


def test_an_unlikely_stretch_is_enough(spark):
    rng = np.random.default_rng(6)
    clean = [prose(np.random.default_rng([7, i]), 0) + " ".join(rng.choice(["baker", "candle", "dinner", "early", "friend", "garden"], 400)) for i in range(60)]
    rows = [(i, t, "en") for i, t in enumerate(clean)]
    rows.append((100, clean[0][:1000] + " qzxwvk " + clean[0][1000:], "en"))
    got = P.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int"), order=4)
    got = {r["doc_id"]: r for r in got.collect()}
    assert all(got[i]["keep"] for i in range(60)) and not got[100]["keep"]
    assert got[100]["stretch"] > got[100]["stretch_limit"]


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5])
def test_ngrams_of_a_few_bytes(size):
    text = b"abcde"[:size]
    padded = b"\n" * 4 + text
    want = [int.from_bytes(padded[i : i + 5], "big") for i in range(size)]
    assert P.ngrams(np.frombuffer(text, np.uint8), np.array([0, size]), 5).tolist() == want


def test_rows_without_an_id_are_compared(spark):
    rng = np.random.default_rng(12)
    base = prose(rng, 120).split()
    change = lambda *at: " ".join("new" if i in at else w for i, w in enumerate(base))
    bridge = [(1, change()), (None, change(60)), (2, change(60, 90))]  # 1 and 2 only link through the row without an id
    other = prose(rng, 120)
    near = [(7, other), (None, other + " tail")]
    rows = [*bridge, *near, (9, prose(rng, 80)), (None, None)]
    sets = [shingles(t, 4) for _, t in bridge]
    like = lambda a, b: 100 * len(a & b) >= 93 * len(a | b)
    assert like(sets[0], sets[1]) and like(sets[1], sets[2]) and not like(sets[0], sets[2])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in jaccard_components(df, 4, 93).collect())
    assert got == groups(rows, 4, 93)


@pytest.mark.parametrize("name,mode", [("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "words")])
def test_strings_of_special_tokens_are_their_ids(name, mode):
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "plain words", "<|startoftext|>x<|endoftext|>", "a <|endoftext| b"]
    ids, width = Encoder(tokenizer_path(name), mode).encode(texts)
    whole = Tokenizer.from_file(tokenizer_path(name))
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(width)[:-1])] == want


@pytest.mark.parametrize("size", [40, 60, 95, 150, 300])
@pytest.mark.parametrize("start", [0, 1, 30, 47, 100])
def test_tagger_spans_longer_than_the_overlap(monkeypatch, size, start):
    def decode(p, code):  # begin at "<", inside for "1"; a window that begins inside a span opens it anew
        tags = np.where(code == ord("<"), 1, np.where(code == ord("1"), 2, 0))
        tags[:, 0] = np.where(tags[:, 0] == 2, 1, tags[:, 0])
        return tags, np.ones(tags.shape)

    monkeypatch.setattr(tagger, "decode", decode)
    text = " " * start + "<" + "1" * (size - 1) + " " * 70
    assert tagger.find(None, [text, "no sign"], re.compile("[0-9@]")) == [[(0, start, start + size)], []]
    assert tagger.find(None, [text, "no sign"], re.compile("<")) == [[(0, start, start + size)], []]


def test_a_query_gets_all_its_neighbours(spark):
    x = np.random.default_rng(8).standard_normal((400, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = nearest(df, F.col("vec_id") % 200 == 0, k=250, ratio=1.0, closure=1.0).orderBy("query_id", "rank").collect()
    for q in (0, 200):  # a list has about 100 rows, so these read all
        want = sorted((np.linalg.norm(x[q] - v), i) for i, v in enumerate(x) if i != q)[:250]
        assert [(r["rank"], r["vec_id"]) for r in got if r["query_id"] == q] == [(k + 1, i) for k, (_, i) in enumerate(want)]
    few = nearest(df.filter("vec_id < 5"), F.col("vec_id") == 0, k=10).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]
