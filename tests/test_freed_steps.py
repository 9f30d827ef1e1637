"""Steps that are kept as tables leave nothing else on disk, and rows travel no more often than they must."""

from pyspark.sql import functions as F

from hindcast.operators import decide as D, metrics as M
from hindcast.operators.history import history, past
from hindcast.plans import hot

from .conftest import assert_same


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_kept_step_and_a_count_of_keys_free_their_shuffle_files(spark, monkeypatch):
    seen, before = [], spark.conf.get(hot.FREED_CONF, None)
    df = spark.range(100).select((F.col("id") % 7).alias("k"))
    writer = type(df.write)
    write = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, path, **kw: (seen.append(spark.conf.get(hot.FREED_CONF)), write(self, path, **kw))[1])
    kept = hot.cut_lineage(df.groupBy("k").count())
    assert seen == ["true"] and kept.count() == 7 and spark.conf.get(hot.FREED_CONF, None) == before
    try:
        with hot.freed(spark), hot.freed(spark):
            assert spark.conf.get(hot.FREED_CONF) == "true"
            raise ValueError
    except ValueError:
        assert spark.conf.get(hot.FREED_CONF, None) == before


def test_carries_of_a_split_history_go_to_the_rows(spark):
    df = spark.range(300).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"), (F.col("id") % 11).alias("x"))
    take = lambda: history(df, "k", "t", s=past("sum", "x", default=0))
    whole = take().collect()
    spark.conf.set(hot.HOT_ROWS_CONF, "40")
    try:
        got = take()
        assert plan(got).count("SortMergeJoin") == 1 and sorted(map(tuple, got.collect())) == sorted(map(tuple, whole))
    finally:
        spark.conf.unset(hot.HOT_ROWS_CONF)


def test_a_shuffle_over_all_rows_does_not_depend_on_its_blocks(spark, monkeypatch):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("g"), F.when(F.col("id") % 50 > 0, F.col("id") * 3).alias("x")).repartition(3)
    take = lambda: D.shuffled_globally(df, ["id"], "x", [1, 2])
    whole = take()
    monkeypatch.setattr(D, "PLACES", 30)
    assert_same(take(), whole, ["seed", "id"])
    rows = {(r["seed"], r["id"]): r for r in whole.collect()}
    h = lambda seed, salt: [r["id"] for r in df.select("id", D.uniform_hash(F.lit(f"{seed}:{salt}"), F.col("id")).alias("h")).orderBy("h", "id").collect()]
    for seed in (1, 2):  # by definition
        for to, of in zip(h(seed, "to"), h(seed, "from"), strict=True):
            assert rows[seed, to]["x"] == (of * 3 if of % 50 else None) and rows[seed, to]["g"] == to % 7


def test_weights_of_the_bootstrap_count_the_probabilities_passed(spark):
    df = spark.range(60).select("id", (F.col("id") % 5 * 30).alias("p"), F.lit(100).alias("s"))
    out = M.bootstrap_ratio(df, ["id"], "p", "s", 40, 11)
    assert plan(out).count("xxhash64") <= 2  # once a row and resample, not once a comparison
    u = (F.pmod(F.xxhash64("id", "b", F.lit(11)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = df.select("*", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("b")).select("*", u.alias("u")).collect()
    steps, term, cum = [], 0.36787944117144233, 0.0
    for k in range(12):
        cum += term
        steps.append(cum)
        term /= k + 1
    x, y = [0] * 41, [0] * 41
    for r in rows:
        w = sum(r["u"] > c for c in steps)
        x[r["b"]] += w * r["p"]
        y[r["b"]] += w * r["s"]
    assert abs(out.first()["mean"] - sum(a / b for a, b in zip(x[1:], y[1:])) / 40) < 1e-12


def test_a_task_is_dealt_as_much_of_a_small_table_as_of_a_large_one(spark, monkeypatch):
    mb, df = 1 << 20, spark.range(10)
    parts = {}
    for size in (60, 600):
        monkeypatch.setattr(hot, "input_bytes", lambda _, size=size: float(size * mb))
        parts[size] = hot.deal(df, "id").rdd.getNumPartitions()
    assert parts[600] == 10 * parts[60]
