"""Several micro-batches give what one batch gives; sinks round-trip."""

from pyspark.sql import functions as F

from hindcast.sources.io import read_parts, read_snapshots, write_snapshots
from hindcast.streaming import keyed as K, ticks as T


def _files(spark, tmp_path):
    """Five files of ticks in time order."""
    df = spark.range(250).select(
        F.col("id").alias("event_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("id") * 3).cast("int"))).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 4).alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") * 7 % 31).cast("double").alias("value"), F.lit("{}").alias("props"),
    ).persist()
    for i in range(5):
        df.filter(F.col("event_id").between(i * 50, i * 50 + 49)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, str(tmp_path / "in")


def test_micro_batches(spark, tmp_path):
    df, path = _files(spark, tmp_path)
    stream = lambda: T.tick_stream(spark, path, per_trigger=2)
    got = T.newest_per_key(T.run_to_table(T.latest_values(stream(), ["user_id"], ["event_id", "value"]), "t1", "update"), ["user_id"])
    want = df.groupBy("user_id").agg(F.max_by("value", "event_id"))
    assert sorted((r[0], r["value"]) for r in got.collect()) == sorted(tuple(r) for r in want.collect())

    running = K.running_features(stream().withColumn("win", (F.col("value") > 15).cast("int")).withColumn("top", F.lit(1)), "user_id", "win", "top")
    out = T.run_to_table(running, "t2").orderBy("user_id", "event_id").collect()
    seen = {}
    values = {r["event_id"]: r["value"] for r in df.collect()}
    for r in out:
        n, w = seen.get(r["user_id"], (0, 0))
        assert (r["n_before"], r["wins_before"]) == (n, w)
        seen[r["user_id"]] = (n + 1, w + (values[r["event_id"]] > 15))


def test_each_group_once(spark, tmp_path):
    df, path = _files(spark, tmp_path)
    groups = spark.createDataFrame([("0", "2024-01-01 05:00:00"), ("1", "2024-01-01 03:00:00"), ("2", "2030-01-01 00:00:00")], "gid string, start string").withColumn("start", F.to_timestamp("start"))
    s = T.tick_stream(spark, path, per_trigger=1).withColumn("gid", F.col("user_id").cast("string"))
    out = T.run_to_table(K.once_before_start(s, groups, "gid", "start"), "t3").collect()
    assert sorted(r["gid"] for r in out) == ["0", "1"]
    last = {g: max(i for i in range(250) if i % 4 == int(g) and i * 3 <= m) for g, m in (("0", 295), ("1", 175))}
    assert {r["gid"]: r["event_id"] for r in out} == last


def test_snapshot_layout(spark, tmp_path):
    path = str(tmp_path / "snap")
    df = spark.createDataFrame([(1, 2023, "T-10"), (2, 2024, "T-10"), (3, 2024, "T-60")], "k int, year int, snapshot_type string")
    write_snapshots(df, path)
    write_snapshots(df.filter("year = 2024").withColumn("k", F.col("k") + 10), path)  # replaces 2024 only
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [1, 12, 13]
    assert [r["k"] for r in read_snapshots(spark, path, 2024, 2026, ["T-10"]).collect()] == [12]


def test_parts_with_different_columns(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "a int, b int").write.parquet(str(tmp_path / "p1"))
    spark.createDataFrame([(3,)], "a int").write.parquet(str(tmp_path / "p2"))
    assert sorted(tuple(r) for r in read_parts(spark, [str(tmp_path / "p1"), str(tmp_path / "p2")]).collect()) == [(1, 2), (3, None)]
