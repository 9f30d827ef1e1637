"""Results must not depend on whether a key is split over tasks."""

import pytest
from pyspark.sql import functions as F

from hindcast.operators import decide, pairs, relative as R
from hindcast.operators.asof import asof_join
from hindcast.operators.calendar import before_group, trailing_days
from hindcast.operators.history import ewm, ewm_recursive, history, lag, last_k, past, seq
from hindcast.operators.quantiles import expanding_mode, expanding_quantile
from hindcast.plans.hot import hot_keys

from .conftest import assert_same


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 holds a third of the rows; values have gaps; several rows share a day."""
    n = 900
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 30).alias("k"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.pmod(F.xxhash64("id"), F.lit(200))).cast("int")).alias("day"),
        F.col("id"),
        F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) > 0, F.pmod(F.xxhash64("id", F.lit(2)), F.lit(17)).cast("int")).alias("x"),
        F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3)).cast("int").alias("kind"),
        (F.col("id") % 60).alias("g"),
    )
    return df.persist()


def both(make, hot, key=("id",), tol=1e-9):
    cold = make()
    cold.collect()
    cold = cold.sparkSession.createDataFrame(cold.collect(), cold.schema)
    hot()
    assert_same(cold, make(), key, tol)


def test_detection(skewed, hot):
    assert hot_keys(skewed, ["k"]) is None
    hot()
    found = hot_keys(skewed, ["k"])
    assert [r["k"] for r in found.table.collect()] == [0]
    assert found.biggest >= 300


def test_history_is_independent_of_the_cut(skewed, hot):
    specs = dict(
        n=seq(), l1=lag("x"), l3=lag("x", 3, default=-1), kind1=lag("kind"), s=past("sum", "x"), c=past("count", "x", default=0),
        m=past("mean", "x", min_n=3), lo=past("min", "x"), hi=past("max", "x"), sd=past("std", "x"), f=past("first", "x"), la=past("last", "x"),
        m5=last_k("mean", "x", 5), sd5=last_k("std", "x", 5, min_n=2, default=0.0), q=last_k("quantile", "x", 50, min_n=8, q=0.75), c20=last_k("count", "x", 20),
    )
    both(lambda: history(skewed, "k", ["day", "id"], **specs), hot)


@pytest.mark.parametrize("limit", [10, 25, 120])
def test_history_at_several_limits(skewed, hot, limit):
    specs = dict(l7=lag("x", 7), m30=last_k("mean", "x", 30), s=past("sum", "x"), sd=past("std", "x"))
    both(lambda: history(skewed, "k", ["day", "id"], **specs), lambda: hot(limit))


def test_null_keys_and_null_times(spark, hot):
    df = spark.range(300).select(
        F.when(F.col("id") % 2 == 0, F.col("id") % 7).alias("k"),
        F.when(F.col("id") % 11 > 0, F.col("id") % 50).alias("t"), "id", (F.col("id") % 13).alias("x"),
    )
    both(lambda: history(df, "k", ["t", "id"], n=seq(), s=past("sum", "x"), l2=lag("x", 2)), hot)


def test_ewm(skewed, hot):
    both(lambda: history(skewed, "k", ["day", "id"], a=ewm("x", 0.5), b=ewm("x", 1 / 3), c=ewm_recursive("x", 0.25)), hot)


def test_ewm_matches_pandas(skewed):
    got = history(skewed, "k", ["day", "id"], a=ewm("x", 0.5), b=ewm_recursive("x", 0.25)).toPandas()
    got = got.sort_values(["k", "day", "id"])
    want_a = got.groupby("k")["x"].transform(lambda s: s.astype(float).shift(1).ewm(span=3, min_periods=1).mean())
    want_b = got.groupby("k")["x"].transform(lambda s: s.astype(float).shift(1).ewm(alpha=0.25, adjust=False).mean())
    assert (got["a"] - want_a).abs().max() < 1e-9 and (got["a"].isna() == want_a.isna()).all()
    assert (got["b"] - want_b).abs().max() < 1e-9


def test_ewm_over_long_gaps_and_histories(spark, hot):
    df = spark.range(2600).select(F.lit(1).alias("k"), "id", F.when((F.col("id") % 700 < 40) | (F.col("id") > 2000), F.col("id") % 19).alias("x"))
    make = lambda: history(df, "k", "id", a=ewm("x", 0.5), b=ewm_recursive("x", 0.3))
    got = make().toPandas().sort_values("id")
    past_x = got["x"].astype(float).shift(1)
    for c, kw in (("a", dict(alpha=0.5)), ("b", dict(alpha=0.3, adjust=False))):
        want = past_x.ewm(**kw).mean()
        assert (got[c] - want).abs().max() < 1e-9 and (got[c].isna() == want.isna()).all(), c
    both(make, lambda: hot(500))


def test_calendar_windows(skewed, hot):
    m = {"n": F.lit(1), "s": F.coalesce("x", F.lit(0))}
    both(lambda: trailing_days(skewed, "k", "day", m, [7, 30, None]), hot)


def test_float_measures_take_the_collapsed_way(skewed, hot):
    both(lambda: trailing_days(skewed, "k", "day", {"s": F.col("x") / 10.0}, [7]), hot)


def test_before_group(skewed, hot):
    both(lambda: before_group(skewed, "k", "g", "day", {"n": F.lit(1), "s": F.coalesce("x", F.lit(0))}), hot)
    

def test_group_totals_and_ranks(skewed, hot):
    def make():
        df = R.totals(skewed, "k", m=F.avg("x"), c=F.count(F.lit(1)))
        for name, method in (("a", "min"), ("b", "average"), ("c2", "dense")):
            df = R.rank(df, "k", name, F.col("x"), method)
        return R.rank(df, "k", "d", -F.col("x"), "first", ["id"])

    both(make, hot)


def test_standing_and_softmax(skewed, hot):
    def make():
        df = R.standing(skewed, "k", "x")
        df = R.softmax(df, "k", "x", "p")
        return R.leave_one_out(df, "k", "x")

    both(make, hot)


def test_kernel_equals_pairs(skewed, hot):
    df = skewed.filter("x is not null").withColumn("w", (F.col("kind") + 1) / 3.0).withColumn("mu", F.col("x") * 0.5)
    a, b = df.alias("a"), df.alias("b")
    want = a.join(b, F.col("a.k") == F.col("b.k")).groupBy("a.id").agg(
        F.sum(F.when(F.col("a.id") != F.col("b.id"), F.exp(-F.abs(F.col("a.mu") - F.col("b.mu")) / 1.5) * F.col("b.w")).otherwise(0.0)).alias("c")
    )
    got = lambda: R.kernel_sum(df, "k", "mu", "w", 1.5, "c").select("id", "c")
    assert_same(want.select("id", "c"), got(), ["id"], 1e-8)
    hot()
    assert_same(want.select("id", "c"), got(), ["id"], 1e-8)


def test_pairs_are_salted_and_complete(skewed, hot):
    both(lambda: pairs.pairs(skewed.select("k", "id"), "k", "id", [], "unordered"), hot, ("k", "id_1", "id_2"))


def test_asof(skewed, hot):
    right = skewed.filter("kind = 0").select("k", F.col("day").alias("rday"), F.col("x").alias("rx"), F.col("id").alias("rid"))
    left = skewed.filter("kind > 0").select("k", "day", "id")
    both(lambda: asof_join(left, right, "k", "day", "rday", ["rx", "rid"], tolerance=10, prefer=[F.col("rid")]), hot)


def test_quantile_and_mode(skewed, hot):
    both(lambda: expanding_quantile(skewed, "k", ["day", "id"], "x", 0.5, "med", min_n=2), hot)
    hot(10_000)
    both(lambda: expanding_mode(skewed, "k", ["day", "id"], "kind", [0, 1, 2], "mode", default=1), hot)


def test_budget_and_equity(skewed, hot):
    df = skewed.withColumn("amount", (F.coalesce("x", F.lit(0)) * 100).cast("long")).withColumn("ev", F.col("id") * 0.01)
    both(lambda: decide.trim_to_budget(df, "k", "amount", "ev", 5000, ties=["id"]), hot)
    hot(10_000)
    df2 = skewed.withColumn("profit", F.coalesce("x", F.lit(0)) * 10 - 90)
    both(lambda: decide.equity(df2, "k", ["day", "id"], "profit", 1000), hot)
