"""Quantiles of prefixes and groups, isotonic blocks, triples, head to head and sweeps against plain definitions."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.operators import decide, pairs
from hindcast.operators.history import history, past, seq
from hindcast.operators.isotonic import isotonic_blocks, isotonic_value, pool
from hindcast.operators.quantiles import expanding_quantile, group_quantiles
from hindcast.operators.ranks import PrefixRanks


def percentile(values, q):
    values = sorted(v for v in values if v is not None)
    if not values:
        return None
    at = (len(values) - 1) * q
    lo, hi = math.floor(at), math.ceil(at)
    return values[lo] if lo == hi else (hi - at) * values[lo] + (at - lo) * values[hi]


def near(a, b):
    return a is None and b is None or a is not None and b is not None and abs(a - b) <= 1e-9 * max(1, abs(b))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- quantiles of prefixes --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 2, 7, 300])
def test_prefix_ranks(size):
    rng = np.random.default_rng(size)
    codes, base = rng.integers(0, size, 400), rng.integers(0, 3, size)
    start, end = np.sort(rng.integers(0, 400, (2, 300)), axis=0)
    ranks = PrefixRanks(codes, size)
    for extra in (None, base):
        more = np.repeat(np.arange(size), extra) if extra is not None else codes[:0]
        some = [i for i in range(300) if end[i] - start[i] + len(more)]
        k = np.array([rng.integers(0, end[i] - start[i] + len(more)) for i in some])
        code, place = ranks.kth(start[some], end[some], k, extra)
        for i, j, c, p in zip(some, k, code, place):
            whole = np.sort(np.concatenate([codes[start[i] : end[i]], more]))
            assert c == whole[j] and p == j - np.searchsorted(whole, c)


def histories(spark, n=1200):
    """A key with a third of the rows, null keys and values, frequent and single values, several rows a day."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        k = [0, None, int(rng.integers(1, 60)), int(rng.integers(1, 60)), 0, int(rng.integers(1, 9))][i % 6]
        v = [None, 1.0, 1.0, float(rng.normal()), float(rng.normal())][int(rng.integers(0, 5))]
        rows.append((k, int(rng.integers(0, 300)), i, v))
    return rows, spark.createDataFrame(rows, "k int, day int, id int, x double").repartition(4)


def brute(rows, q, least):
    out, seen = {}, {}
    for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        own = seen.setdefault(k, [])
        known = [x for x in own if x is not None]
        out[i] = percentile(known, q) if len(known) >= least else None
        own.append(v)
    return out


@pytest.mark.parametrize("limit,q", [(None, 0.5), (40, 0.5), (25, 0.9), (130, 0.0)])
def test_expanding_quantile_of_any_values(spark, hot, limit, q):
    rows, df = histories(spark)
    if limit:
        hot(limit)
    got = expanding_quantile(df, "k", ["day", "id"], "x", q, "m", min_n=2)
    assert got.columns == ["k", "day", "id", "x", "m"]
    want = brute(rows, q, 2)
    found = {r["id"]: r["m"] for r in got.collect()}
    assert len(found) == len(rows) and all(near(found[i], want[i]) for i in want)


def test_past_quantile_of_hot_keys(spark, hot):
    rows, df = histories(spark, 600)
    hot()
    want = brute(rows, 0.25, 1)
    got = history(df, "k", ["day", "id"], n=seq(), low=past("quantile", "x", q=0.25, default=-9.0), s=past("sum", "x")).collect()
    assert len(got) == 600 and all(near(r["low"], -9.0 if want[r["id"]] is None else want[r["id"]]) for r in got)


def test_a_million_rows_of_one_key(spark):
    """The old plan computes a percentile of every prefix, about 5 * 10^11 values."""
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("k"), "id", (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 7.0).alias("x"))
    times = []
    for rows in (n // 4, n):
        t = time.time()
        got = expanding_quantile(df.filter(F.col("id") < rows), "k", "id", "x", 0.5, "m").filter(F.col("id") % 99_991 == 17).orderBy("id").collect()
        times.append(time.time() - t)
    x = np.array([r["x"] for r in df.orderBy("id").select("x").collect()])
    assert all(near(r["m"], float(np.median(x[: r["id"]]))) for r in got)
    assert times[1] < 12 * max(times[0], 1.0)  # linear-log: about 4.4 times; quadratic: 16 times


# --- quantiles of groups ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("last", [200_000, 60])
def test_group_quantiles(spark, last):
    rng = np.random.default_rng(5)
    rows = [(["a", "b", None, "c"][min(3, i % 7)], float(rng.normal()) if i % 3 else 2.5, [1, None, 3][i % 3] if i % 7 != 2 else None) for i in range(900)]
    rows += [("void", None, None), ("one", 4.0, 1), ("same", 7.0, 1), ("same", 7.0, 2)] + [("equal", 1.5, 1)] * 200
    df = spark.createDataFrame(rows, "g string, x double, y int").repartition(5)
    wanted = {"lo": (F.col("x"), 0.05), "mid": (F.col("x"), 0.5), "hi": (F.col("x"), 0.95), "most": (F.col("x"), 1.0), "y": (F.col("y"), 0.5)}
    got = {r["g"]: r for r in group_quantiles(df, ["g"], wanted, last).collect()}
    groups = {g for g, _, _ in rows}
    assert set(got) == groups
    for g in groups:
        for name, (column, q) in {"lo": (1, 0.05), "mid": (1, 0.5), "hi": (1, 0.95), "most": (1, 1.0), "y": (2, 0.5)}.items():
            assert near(got[g][name], percentile([r[column] for r in rows if r[0] == g], q)), (g, name)
    assert group_quantiles(df.limit(0), ["g"], wanted, last).count() == 0


# --- isotonic ---------------------------------------------------------------------------------------------------------


def definition(points):
    """(score, total, weight) in order: the greatest of the least means around each."""
    n = len(points)
    t, w = (np.concatenate([[0], np.cumsum([p[i] for p in points])]) for i in (1, 2))
    mean = [[(t[b + 1] - t[a]) / (w[b + 1] - w[a]) if b >= a else math.inf for b in range(n)] for a in range(n)]
    return [max(min(mean[a][i:]) for a in range(i + 1)) for i in range(n)]


@pytest.mark.parametrize("stretch", [None, 12])
@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "steps"])
def test_isotonic_blocks(spark, shape, stretch):
    rng = np.random.default_rng(7)
    s = rng.integers(0, 90, 400) / 90
    y = {"noise": rng.random(400) < s, "rising": s, "falling": 1 - s, "steps": np.floor(s * 5) % 2}[shape].astype(float)
    rows = [(float(a), float(b)) for a, b in zip(s, y)] + [(None, 1.0), (math.nan, 1.0), (0.5, None)]
    df = spark.createDataFrame(rows, "p double, y double").repartition(3)
    blocks = isotonic_blocks(df, "p", "y", stretch=stretch)
    points = [(v, y[s == v].sum(), (s == v).sum()) for v in sorted(set(s))]
    want = dict(zip([p[0] for p in points], definition(points)))
    got = {r["p"]: r["v"] for r in isotonic_value(df, blocks, "p", "v").filter("p IS NOT NULL AND NOT isnan(p)").collect()}
    assert set(got) == set(want) and all(abs(got[v] - want[v]) < 1e-9 for v in want)
    means = [r["value"] for r in blocks.orderBy("lo").collect()]
    assert all(a < b for a, b in zip(means, means[1:]))


def test_isotonic_values_between_and_beyond_blocks(spark):
    fit = spark.createDataFrame([(0.2, 0.0), (0.3, 0.0), (0.6, 1.0), (0.8, 1.0)], "p double, y double")
    ask = spark.createDataFrame([(0.0, 1), (0.25, 2), (0.45, 3), (0.7, 4), (0.9, 5), (None, 6)], "p double, lo int")
    got = {r["lo"]: r["v"] for r in isotonic_value(ask, isotonic_blocks(fit, "p", "y"), "p", "v").collect()}
    assert got.pop(6) is None and all(abs(got[i] - v) < 1e-9 for i, v in {1: 0.0, 2: 0.0, 3: 0.5, 4: 1.0, 5: 1.0}.items())
    assert isotonic_blocks(fit.limit(0), "p", "y").count() == 0


def test_pool_is_independent_of_the_cuts():
    rng = np.random.default_rng(11)
    y = rng.random(500)
    x, one = np.arange(500.0), np.ones(500)
    whole = pool(x, x, y, one)
    parts = [pool(x[a : a + 61], x[a : a + 61], y[a : a + 61], one[a : a + 61]) for a in range(0, 500, 61)]
    joined = pool(*(np.concatenate(c) for c in zip(*parts)))
    assert all(np.allclose(a, b) for a, b in zip(whole, joined))


# --- triples, head to head, sweeps ------------------------------------------------------------------------------------


@pytest.mark.parametrize("how", ["ordered", "unordered"])
def test_triples_of_a_hot_group(spark, monkeypatch, how):
    monkeypatch.setattr(pairs, "TRIPLE_ROWS", 4)
    rows = [(1, i) for i in range(23)] + [(2, i) for i in range(5)] + [(3, 0), (3, 1), (None, 1)]
    df = spark.createDataFrame(rows, "g int, k int").withColumn("v", F.col("k") * 2)
    got = sorted((r["g"], r["k_1"], r["k_2"], r["k_3"]) for r in pairs.triples(df, "g", "k", ["v"], how).collect())
    make = itertools.permutations if how == "ordered" else itertools.combinations
    want = sorted((g, *t) for g in (1, 2, 3) for t in make(sorted(k for h, k in rows if h == g), 3))
    assert got == want


def test_triples_are_dealt_once(spark):
    df = spark.range(600).select((F.col("id") % 50).alias("g"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert plan(pairs.triples(df, "g", "id", [], "unordered")).count("Exchange hashpartitioning") <= 3
        runs = df.select("g", F.col("g").alias("day"), (F.col("id") % 37).alias("e"), "id")
        assert plan(pairs.head_to_head(runs, "g", "day", "e", "id")).count("Exchange hashpartitioning") <= 6
        axes = {"t": (F.col("id") / 600, [0.1, 0.5]), "u": (F.col("g") / 50, [0.0, 0.3, 0.6])}
        swept = plan(decide.sweep(df, axes, F.lit(100), F.col("id"), variants={"s": [1.0, 2.0]}))
        assert "Join" not in swept
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_sweep_counts_every_setting(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b) if b > 0.1 else None, int(c)) for a, b, c in zip(rng.random(300), rng.random(300), rng.integers(0, 500, 300))]
    df = spark.createDataFrame(rows, "p double, e double, pay int")
    t, u, s = [0.0, 0.25, 0.5, 0.9], [0.3, 0.2, 0.7], [1.0, 0.8]
    axes = {"t": (F.col("p") * F.col("s"), t), "u": (F.col("e"), u)}
    got = {(r["t"], r["u"], r["s"]): (r["bets"], r["payout"]) for r in decide.sweep(df, axes, F.lit(100), F.col("pay") * F.col("s"), variants={"s": s}).collect()}
    want = {}
    for a, b, c in itertools.product(t, u, s):
        some = [r for r in rows if r[0] * c >= a and r[1] is not None and r[1] >= b]
        if some:
            want[a, b, c] = (len(some), sum(r[2] * c for r in some))
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and near(got[k][1], want[k][1]) for k in want)
