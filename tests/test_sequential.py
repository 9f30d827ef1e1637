"""Order-dependent folds: worked values, and the slice-wise way equals the single pass."""

import math

from pyspark.sql import functions as F

from hindcast.operators.sequential import capped_equity, capped_stake, ratings

from .conftest import assert_same


def test_first_two_groups_by_hand(spark):
    df = spark.createDataFrame([("p", "g1", 1, 1, "a", 1), ("p", "g1", 1, 2, "b", 2), ("p", "g2", 2, 1, "a", 2), ("p", "g2", 2, 2, "c", 1)], "pool string, g string, t int, k int, e string, o int")
    got = {(r["g"], r["e"]): r["rating"] for r in ratings(df, "pool", "g", "e", "o", "t", ["k"]).collect()}
    assert got["g1", "a"] == got["g1", "b"] == got["g2", "c"] == 1500.0
    assert math.isclose(got["g2", "a"], 1500 + 32 * (1.0 - 0.5))


def test_rating_slices(spark, hot):
    df = spark.range(240).select(
        (F.col("id") % 2).alias("pool"), F.floor(F.col("id") / 6).alias("g"), F.floor(F.col("id") / 6).alias("t"), (F.col("id") % 6).alias("k"),
        F.pmod(F.xxhash64("id"), F.lit(15)).alias("e"), (F.floor(F.col("id") % 6 / 2) + 1).cast("int").alias("o"),
    ).withColumn("g", F.col("g") * 2 + F.col("pool"))
    make = lambda: ratings(df, "pool", "g", "e", "o", "t", ["k"]).select("pool", "g", "k", "e", "rating")
    one = spark.createDataFrame(make().collect(), make().schema)
    hot(50)
    assert_same(one, make(), ["pool", "g", "k"])


def test_stake_cap():
    assert capped_stake(1000, 100000, 0.05, 1000, 100, "scale") == 1000
    assert capped_stake(10000, 100000, 0.05, 1000, 100, "scale") == 5000
    assert capped_stake(10000, 100000, 0.05, 1000, 100, "skip") == 0
    assert capped_stake(100, 900, 0.05, 1000, 100, "scale") == 0
    assert capped_stake(1000, 1900, 0.05, 1000, 100, "scale") == 0


def test_equity_slices(spark, hot):
    df = spark.range(300).select((F.col("id") % 3).alias("s"), "id", F.lit(6000.0).alias("want"), (F.pmod(F.xxhash64("id"), F.lit(13)) * 1000.0).alias("pays"))
    make = lambda: capped_equity(df, "s", ["id"], "want", "pays")
    one = spark.createDataFrame(make().collect(), make().schema)
    hot(40)
    assert_same(one, make(), ["s", "id"])
    assert make().agg(F.min("equity")).first()[0] >= 0


def test_ratings_by_definition_and_in_one_pass(spark, monkeypatch):
    """Groups that share no entity are rated at once; every stretch, entity type and doubled entity gives the same."""
    from hindcast.operators import sequential as Q

    rows = [(i % 3, i // 5, i % 5, (i * 7919) % 23, (None, 1, 2, 2, 4)[(i * 31) % 5]) for i in range(600)]
    rows = [(p % 2, 2 * g + p % 2, k, e, o) for p, g, k, e, o in rows] + [(9, 1, 1, None, 1), (9, 2, 1, None, 2), (None, 1, 1, 5, 1)]
    want, state = {}, {}
    for pool, g in sorted({r[:2] for r in rows if r[0] in (0, 1)}):
        field = sorted((r for r in rows if r[:2] == (pool, g)), key=lambda r: r[2])
        before = [state.get((pool, r[3]), 1500.0) for r in field]
        known = [(b, r[4]) for b, r in zip(before, field) if r[4] is not None]
        mean = sum(b for b, _ in known) / max(1, len(known))
        for r, b in zip(field, before):
            want.setdefault((pool, g, r[2], r[3]), []).append(b)
            actual = float(r[4] == 1) if len(field) == 1 else (len(field) - (r[4] or 0)) / (len(field) - 1)
            state[pool, r[3]] = b if r[4] is None else b + 32 * (actual - 1 / (1 + 10 ** ((mean - b) / 400)))
    df = spark.createDataFrame(rows, "pool int, g int, k int, e int, o int")
    take = lambda d: {(r["pool"], r["g"], r["k"], r["e"]): r["rating"] for r in ratings(d, "pool", "g", "e", "o", "g", ["k"]).collect()}
    got = take(df)
    assert len(got) == len(rows) and all(math.isclose(got[at], v[0], abs_tol=1e-9) for at, v in want.items())
    assert got[9, 1, 1, None] == got[9, 2, 1, None] == 1500.0
    jobs = []
    keep = Q.cut_lineage
    monkeypatch.setattr(Q, "cut_lineage", lambda d: (jobs.append(d._jdf.queryExecution().optimizedPlan().toString()), keep(d))[1])
    monkeypatch.setattr(Q, "FOLD_ROWS", 25)
    assert take(df) == got and len(jobs) == 1 and "FlatMap" not in jobs[0]  # stretches are no jobs of their own
    named = take(df.withColumn("e", F.concat(F.lit("e"), "e")))
    assert all(math.isclose(v, got[p, g, k, int(e[1:])]) for (p, g, k, e), v in named.items() if e)
