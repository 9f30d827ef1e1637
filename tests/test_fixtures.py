"""Small worked examples and algebraic laws."""

import math

import pytest
from pyspark.sql import functions as F

from hindcast.functions import scalars as S
from hindcast.operators import calibrate, clean, decide, metrics as M, pairs as P, relative as R
from hindcast.operators.asof import snapshots
from hindcast.operators.calendar import before_group, trailing_days
from hindcast.operators.history import history, lag, past


def test_class_window_is_closed_on_the_left(spark):
    df = spark.createDataFrame(
        [("h1", "2022-01-01", "r1", "005", 1), ("h1", "2022-02-01", "r2", "005", 4), ("h1", "2022-03-01", "r3", "005", 1),
         ("h2", "2022-01-01", "r4", "005", 1), ("h2", "2022-02-01", "r5", "010", 5)],
        "e string, d string, g string, c string, o int",
    ).withColumn("d", F.to_date("d"))
    out = trailing_days(df, ["e", "c"], "d", {"n": F.lit(1), "t": (F.col("o") <= 3).cast("int")}, [365])
    got = {r["g"]: (r["n_365d"], r["t_365d"]) for r in out.collect()}
    assert got == {"r1": (0, 0), "r2": (1, 1), "r3": (2, 1), "r4": (0, 0), "r5": (0, 0)}


def test_same_group_rows_do_not_see_each_other(spark):
    df = spark.createDataFrame(
        [("R1", "2024-01-01", "J1", 1), ("R1", "2024-01-01", "J1", 3), ("R2", "2024-01-08", "J1", 2), ("R2", "2024-01-08", "J2", 1)],
        "g string, d string, p string, o int",
    ).withColumn("d", F.to_date("d"))
    out = before_group(df, "p", "g", "d", {"n": F.lit(1)})
    assert sorted((r["g"], r["p"], r["n_before"]) for r in out.collect()) == [("R1", "J1", 0), ("R1", "J1", 0), ("R2", "J1", 2), ("R2", "J2", 0)]


def test_deadline_excludes_later_ticks(spark):
    ticks = spark.createDataFrame([("g", "2024-01-01 14:49:59", 1.0), ("g", "2024-01-01 14:50:00", 2.0), ("g", "2024-01-01 14:50:01", 3.0)], "g string, ts string, v double")
    ticks = ticks.withColumn("ts", F.to_timestamp("ts"))
    groups = spark.createDataFrame([("g", "2024-01-01 15:00:00")], "g string, start string").withColumn("start", F.to_timestamp("start"))
    r = snapshots(ticks, groups, "g", "ts", "start", ["v"], {"t10": 10, "t60": 60}).first()
    assert (r["v_t10"], r["v_t60"]) == (2.0, None)


def test_probability_mass(spark):
    p = [0.4, 0.2, 0.1] + [0.05] * 5 + [0.025] * 2
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(p)], "g string, k int, p double")
    two = P.pairs(df, "g", "k", ["p"], "ordered")
    assert math.isclose(two.agg(F.sum(P.exacta(F.col("p_1"), F.col("p_2")))).first()[0], 1, abs_tol=1e-9)
    un = P.pairs(df, "g", "k", ["p"], "unordered")
    assert un.count() == 45 and math.isclose(un.agg(F.sum(P.quinella(F.col("p_1"), F.col("p_2")))).first()[0], 1, abs_tol=1e-9)
    second = P.second_place(df, "g", "p", "p2").agg(F.sum("p2")).first()[0]
    third = P.third_place(df, "g", "k", "p").agg(F.sum("p_third")).first()[0]
    assert math.isclose(second, 1, abs_tol=1e-9) and math.isclose(third, 1, abs_tol=1e-9)
    assert math.isclose(P.both_in_top3(df, "g", "k", "p").agg(F.sum("p")).first()[0], 3, abs_tol=1e-9)


def test_normalise_and_softmax(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("z", 0.0), ("z", 0.0)], "g string, x double")
    got = R.normalise(df, "g", "x", "p").collect()
    assert sorted(r["p"] for r in got if r["g"] == "a") == [0.25, 0.75] and all(r["p"] is None for r in got if r["g"] == "z")
    big = spark.createDataFrame([("a", 1000.0), ("a", 999.0)], "g string, x double")
    one = sorted(r["p"] for r in R.softmax(big, "g", "x").collect())
    two = sorted(r["p"] for r in R.softmax(big, "g", "x", temperature=2.0).collect())
    assert math.isclose(sum(one), 1) and two[1] < one[1]


def test_equity_and_ruin(spark):
    df = spark.createDataFrame([(1, 1, -50000.0), (1, 2, -60000.0), (1, 3, 10000.0), (2, 1, 1000.0), (2, 2, 2000.0), (2, 3, 3000.0)], "s int, t int, x double")
    out = decide.equity(df, "s", "t", "x", 100000)
    got = {(r["s"], r["t"]): (r["equity"], r["drawdown"]) for r in out.collect()}
    assert [got[1, t] for t in (1, 2, 3)] == [(50000.0, 0.5), (0.0, 1.0), (0.0, 1.0)]
    assert [got[2, t][0] for t in (1, 2, 3)] == [101000.0, 103000.0, 106000.0] and got[2, 3][1] == 0.0
    free = decide.equity(df.filter("s = 1"), "s", "t", "x", 100000, stop=False)
    assert [r["equity"] for r in free.orderBy("t").collect()] == [50000.0, -10000.0, 0.0]


def test_portfolio_keeps_the_budget(spark):
    df = spark.createDataFrame([("g", "win", 2.0, 0.6, 1.2), ("g", "win", 2.0, 0.4, 0.8), ("g", "umaren", 10.0, 0.15, 1.5)], "g string, k string, odds double, p double, ev double")
    out = decide.portfolio(df, "g", "k", "odds", "ev", {}, budget=1000.0).collect()
    amount = {r["k"]: r["amount"] for r in out}
    assert len(out) == 2 and 0 < sum(amount.values()) <= 1000 and amount["win"] > amount["umaren"]


def test_ranking_metrics(spark):
    df = spark.createDataFrame([("g", o) for o in range(1, 6)] + [("one", 1)], "g string, o int")
    gain = 1.0 / F.col("o")
    best = {r["g"]: r for r in M.ranking_quality(df, "g", -F.col("o"), gain, F.col("o") == 1, 5, ["o"]).collect()}
    worst = {r["g"]: r for r in M.ranking_quality(df, "g", F.col("o"), gain, F.col("o") == 1, 3, ["o"]).collect()}
    assert math.isclose(best["g"]["ndcg"], 1) and best["one"]["ndcg"] is None
    assert worst["g"]["ndcg"] < 1 and worst["g"]["recall"] == 0 and best["g"]["recall"] == 1


def test_packed_layouts(spark):
    df = spark.createDataFrame([("01001203020000040399990500      06", "0102000123004" + "0000999999001")], "w string, p string")
    r = df.select(S.unpack("w", "win").alias("w"), S.unpack("p", "pair").alias("p")).first()
    assert [(x["key"], x["price"]) for x in r["w"]][:3] == [("01", 1.2), ("02", None), ("03", None)]
    assert [(x["key"], x["price"], x["pop_rank"]) for x in r["p"]] == [("0102", 12.3, 4)]


def test_year_wrap_and_clock(spark):
    df = spark.createDataFrame([("2025-01-01 00:10:00", "12312350", "1234", "12a4")], "s string, a string, t string, b string").withColumn("s", F.to_timestamp("s"))
    r = df.select(S.tick_time_near("s", "a").cast("string"), S.clock_seconds("t"), S.clock_seconds("b")).first()
    assert r[0] == "2024-12-31 23:50:00" and math.isclose(r[1], 83.4) and r[2] is None


def test_leak_guards():
    with pytest.raises(ValueError):
        clean.guard_columns(["x", "rank"])
    assert clean.allowed_columns(["id", "rank", "a", "b_raw", "b_raw_is_missing"], ["id"], ["_raw"]) == ["a", "b_raw_is_missing"]
    assert clean.suspicious_columns(["final_time", "lag1_rank", "mean_time", "weight"]) == ["final_time"]


def test_holdout_year(spark):
    df = spark.createDataFrame([("2024-05-01",)], "d string").withColumn("d", F.to_date("d"))
    with pytest.raises(ValueError):
        clean.years(df, "d", 2023, 2024, holdout=2024)
    assert clean.years(df, "d", 2023, 2024, holdout=2024, allow_holdout=True).count() == 1


def test_future_does_not_change_the_past(spark):
    df = spark.range(200).select((F.col("id") % 5).alias("k"), "id", (F.col("id") * 7 % 11).alias("x"))
    noisy = df.withColumn("x", F.when(F.col("id") >= 120, F.lit(999)).otherwise(F.col("x")))
    f = lambda d: [tuple(r) for r in history(d, "k", "id", a=past("mean", "x"), b=lag("x", 2)).filter("id < 120").orderBy("id").select("a", "b").collect()]
    assert f(df) == f(noisy)


def test_beta_and_isotonic_stay_probabilities(spark):
    df = spark.range(400).select(((F.col("id") % 101) / 100.0).alias("p"), (F.pmod(F.xxhash64("id"), F.lit(100)) < F.col("id") % 101).cast("int").alias("y"))
    a, b, c = calibrate.fit_beta(df, "p", "y")
    lo, hi = df.select(calibrate.apply_beta("p", a, b, c).alias("q")).agg(F.min("q"), F.max("q")).first()
    assert 0 < lo < hi < 1
    iso = calibrate.apply_isotonic(calibrate.fit_isotonic(df, "p", "y"), df, "p").orderBy("p").collect()
    vals = [r["calibrated"] for r in iso]
    assert all(0 <= v <= 1 for v in vals) and vals == sorted(vals)


def test_placebo_permutes_inside_the_group(spark):
    df = spark.range(60).select((F.col("id") % 6).alias("g"), "id", (F.col("id") * 1.5).alias("p"))
    out = decide.shuffled_within(df, "g", ["id"], "p", F.lit(3))
    per = lambda d: {r["g"]: sorted(r["v"]) for r in d.groupBy("g").agg(F.collect_list("p").alias("v")).collect()}
    assert per(df) == per(out) and out.join(df, ["id", "p"]).count() < 60
