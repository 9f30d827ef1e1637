"""Batch state that is read before it is written, and shuffles over all rows."""

import uuid

from pyspark.sql import functions as F

from hindcast.operators.decide import shuffled_globally
from hindcast.operators.state import StateTable


def make(tmp_path):
    return StateTable(f"{tmp_path}/{uuid.uuid4().hex}", ["k"], {"n": ("count", F.lit(1)), "s": ("sum", F.col("x")), "lo": ("min", F.col("x")), "hi": ("max", F.col("x"))}, buckets=4)


def batches(spark):
    rows = [(b, [None, 1, 2, 3, 4][(i * (b + 1)) % 5], None if i % 7 == 0 else i) for b in range(3) for i in range(40)] + [(2, 99, 5)]
    df = spark.createDataFrame(rows, "b int, k int, x int")
    return rows, [df.filter(F.col("b") == b) for b in range(3)]


def totals(rows, before):
    out = {}
    for b, k, x in rows:
        if b < before:
            n, s, lo, hi = out.get(k, (0, None, None, None))
            if x is not None:
                s, lo, hi = (s or 0) + x, x if lo is None else min(lo, x), x if hi is None else max(hi, x)
            out[k] = (n + 1, s, lo, hi)
    return out


def read(df):
    return {r["k"]: (r["n"], r["s"], r["lo"], r["hi"]) for r in df.collect()}


def test_three_batches_equal_one_pass_and_a_replay_changes_nothing(spark, tmp_path):
    rows, parts = batches(spark)
    table = make(tmp_path)
    assert table.state(spark) is None
    for b, part in enumerate(parts):
        want = totals(rows, b)
        seen = table.apply(part, f"b{b}").collect()
        assert len(seen) == part.count() and all((r["n"], r["s"], r["lo"], r["hi"]) == want.get(r["k"], (None,) * 4) for r in seen)
        assert read(table.state(spark)) == totals(rows, b + 1)
    files = sorted(str(p) for p in tmp_path.rglob("*.parquet"))
    again = table.apply(parts[1], "b1").collect()  # late, and a second time
    assert all((r["n"], r["s"], r["lo"], r["hi"]) == totals(rows, 1).get(r["k"], (None,) * 4) for r in again)
    assert sorted(str(p) for p in tmp_path.rglob("*.parquet")) == files and read(table.state(spark)) == totals(rows, 3)


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    _, parts = batches(spark)
    table = make(tmp_path)
    table.apply(parts[0], "all")
    table.apply(parts[2].filter("k = 99"), "one")
    assert table.log(spark).filter("version = 2").count() == 1 == len(list(tmp_path.glob("*/data/version=2/bucket=*")))
    table.apply(parts[0].limit(0), "none")
    assert table.state(spark).count() == 6


def test_a_batch_that_broke_off_before_its_log_is_not_seen(spark, tmp_path):
    rows, parts = batches(spark)
    table = make(tmp_path)
    table.apply(parts[0], "b0")
    parts[2].selectExpr("k", "1L AS n", "1L AS s", "1 AS lo", "1 AS hi", "0 AS bucket").write.partitionBy("bucket").parquet(f"{table.path}/data/version=2")
    assert read(table.state(spark)) == totals(rows, 1)
    table.apply(parts[1], "b1")
    assert read(table.state(spark)) == totals(rows, 2)


def test_a_global_shuffle_keeps_all_values_and_does_not_depend_on_the_cut(spark, hot):
    df = spark.range(400).select("id", (F.col("id") % 7).alias("g"), (F.col("id") * 3).alias("x")).repartition(3)
    take = lambda: sorted(tuple(r) for r in shuffled_globally(df, ["id"], "x", [1, 2]).select("seed", "id", "g", "x").collect())
    whole = take()
    hot(50)
    assert take() == whole
    for seed in (1, 2):
        own = [r for r in whole if r[0] == seed]
        assert sorted(r[3] for r in own) == [3 * i for i in range(400)] and sum(r[3] == 3 * r[1] for r in own) < 20
    assert [r[3] for r in whole[:400]] != [r[3] for r in whole[400:]]
