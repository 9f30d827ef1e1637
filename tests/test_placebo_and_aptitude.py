"""Seeds are shuffled without windows of their own, one after the other where all rows move; six sets of keys take two exchanges."""

import uuid

from pyspark.sql import functions as F

from hindcast.operators import decide as D
from hindcast.plans import features as B, hot

from .conftest import assert_same


def groups(spark):
    return spark.range(240).select((F.col("id") % 60).alias("g"), "id", (F.col("id") % 3).alias("k"), F.when(F.col("id") % 9 > 0, F.col("id") * 0.5).alias("p"))


def test_all_seeds_are_shuffled_inside_the_array_of_a_group(spark, monkeypatch):
    df, seeds = groups(spark).unionByName(groups(spark).filter("g > 57").withColumn("g", F.lit(None).cast("long"))), [0, 1, 5]
    fan = df.select("*", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    want = D.shuffled_within(fan, ["g", "seed"], ["k", "id"], "p", F.col("seed")).select("g", "seed", "id", "k", "p")
    got = D.shuffled_within_all(df, "g", ["k", "id"], "p", seeds)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert_same(got, want, ["seed", "g", "id"])
    monkeypatch.setattr(D, "ARRAY_ROWS", 3)  # and with groups that are too large for an array
    assert_same(D.shuffled_within_all(df, "g", ["k", "id"], "p", seeds), want, ["seed", "g", "id"])


def test_what_a_seed_moved_is_gone_before_the_next(spark, monkeypatch):
    df, kept = groups(spark), []
    keep = D.cut_lineage
    monkeypatch.setattr(D, "cut_lineage", lambda d: (kept.append(d), keep(d))[1])
    best = lambda d: d.groupBy("seed").agg(F.sum("p").alias("p"), F.count("*").alias("n"))
    got = D.shuffled_globally(df, ["id"], "p", [3, 4], best)
    assert [d.columns for d in kept if "n" in d.columns] == [["seed", "p", "n"]] * 2  # one table a seed, none with its rows
    assert_same(got, best(D.shuffled_globally(df, ["id"], "p", [3, 4])), ["seed"])


def test_extended_aptitude_moves_rows_for_parents_and_persons_only(spark, tmp_path, monkeypatch):
    at = f"{tmp_path}/{uuid.uuid4().hex}"
    i = F.col("id")
    spark.range(400).select(
        (i % 90).alias("group_id"), i.alias("line"), (i % 11).alias("entity"), F.when(i % 17 > 0, i % 7).alias("person_a"), F.when(i % 19 > 0, i % 3).alias("parent"), (i % 90 % 10 + 1).cast("int").alias("venue"),
        F.date_add(F.lit("2020-01-01").cast("date"), (i % 90 / 4).cast("int")).alias("day"), (i % 5 + 1).cast("int").alias("outcome"),
    ).write.parquet(at)
    df = spark.read.parquet(at)
    take = lambda: B.build(df, ["extended_aptitude"])
    want = spark.createDataFrame(take().collect(), take().schema)
    monkeypatch.setattr(hot, "DEAL_FROM", 10)
    monkeypatch.setattr(hot, "TASK_BYTES", hot.input_bytes(df) / 2.5)
    from hindcast.operators import slices

    monkeypatch.setattr(slices, "SLICE_ROWS", 50)
    got = take()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(person_a") == 1, [x.strip()[:150] for x in plan.splitlines() if "Exchange" in x]
    assert_same(got, want, ["line"])
