"""What one task holds does not grow with the input: large tables are dealt over more partitions, small ones are left alone."""

import uuid

from pyspark.sql import functions as F

from hindcast.plans import hot
from hindcast.sources import tables


def star(spark, tmp_path, orders=300):
    d = f"{tmp_path}/{uuid.uuid4().hex}"
    li = spark.range(orders * 4).select(
        (F.col("id") % orders).alias("l_orderkey"), (F.col("id") % 17).alias("l_partkey"), (F.col("id") % 11).alias("l_suppkey"),
        (F.col("id") / orders).cast("int").alias("l_linenumber"), (F.col("id") % 50 + 1).cast("double").alias("l_quantity"),
        ((F.col("id") * 37) % 1000 + 1).cast("double").alias("l_extendedprice"), F.lit(0.05).alias("l_discount"), F.lit(0.02).alias("l_tax"),
        F.lit("A").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
    )
    o = spark.range(orders).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"),
        F.timestamp_seconds(F.lit(800_000_000) + F.col("id") * 86400).alias("o_orderdate"),
    )
    li.write.parquet(f"{d}/lineitem.parquet")
    o.write.parquet(f"{d}/orders.parquet")
    return d


def test_the_number_of_partitions_follows_the_stored_bytes(spark, tmp_path, monkeypatch):
    d = star(spark, tmp_path)
    key = ["group_id", "line", "entity", "person_a"]
    small = tables.entries(spark, d)
    want = sorted(tuple(r) for r in small.collect())
    monkeypatch.setattr(hot, "DEAL_FROM", 100)
    monkeypatch.setattr(hot, "TASK_BYTES", hot.input_bytes(tables.table(spark, d, "lineitem")) / 23.5)
    large = tables.entries(spark, d)
    assert large.rdd.getNumPartitions() == 24 > small.rdd.getNumPartitions()
    assert sorted(tuple(r) for r in large.collect()) == want and len({tuple(r[c] for c in key) for r in large.collect()}) == len(want)
    # Groups stay where they were dealt to: what is done by group moves nothing again.
    by_group = large.groupBy("group_id").agg(F.max("outcome"))
    assert by_group.rdd.getNumPartitions() == 24


def test_a_factor_deals_finer(spark, tmp_path, monkeypatch):
    spark.range(1000).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(hot, "DEAL_FROM", 100)
    monkeypatch.setattr(hot, "TASK_BYTES", hot.input_bytes(df) / 2.5)
    assert [hot.deal(df, "id", factor=f).rdd.getNumPartitions() for f in (1, 4)] == [3, 12]


def test_a_fold_takes_slices_of_its_own_size(spark, monkeypatch):
    from hindcast.operators import sequential as Q

    rows = [(i % 2, i // 4, i // 8, i % 13, i % 4 + 1) for i in range(400)]
    df = spark.createDataFrame(rows, "pool int, g int, day int, e int, o int")
    take = lambda: sorted(tuple(r) for r in Q.ratings(df, "pool", "g", "e", "o", "day", ["e"]).collect())
    whole = take()
    monkeypatch.setattr(Q, "FOLD_ROWS", 30)
    assert len(Q._slices(df, "pool", "day")) > 5 and take() == whole


def test_a_capped_day_keeps_the_places_of_what_is_bought_only(spark):
    from hindcast.operators.decide import day_cap

    rows = [(d, g, (300, 400, 1000)[(g * 7 + d) % 3]) for d in range(2) for g in range(600)]
    got = day_cap(spark.createDataFrame(rows, "day int, g int, amount int"), "day", ["g"], "amount", 4000, "g", 900)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_zip" not in plan and "array_contains" in plan  # not an answer for every row, copied with each step
    bought = {(r["day"], r["g"]) for r in got.collect() if r["bought"]}
    for d in range(2):
        spent = 0
        for _, g, a in sorted(r for r in rows if r[0] == d):
            ok = a <= 900 and spent + a <= 4000
            spent += a if ok else 0
            assert ((d, g) in bought) == ok
