"""Few large keys: rows are dealt by stretches of days, and what comes out is the same however they are cut."""

import random
import re

import pytest

from hindcast.operators import slices
from hindcast.operators.history import COPY
from hindcast.plans import features as B, hot

SCHEMA = "group_id long, line int, entity long, person_a long, parent long, parent2 long, day date, day_no int, outcome int, surface string, distance int, going int"


def frame(spark, tmp_path, seed=3):
    import datetime

    r = random.Random(seed)
    rows = []
    for g in range(150):
        day = None if g % 41 == 0 else r.randrange(30) * (g % 7 > 0)
        for line in range(r.randrange(1, 7)):
            some = lambda x: None if r.random() < 0.06 else x
            e = r.randrange(60)
            rows.append((None if g % 53 == 0 else g, line, e, r.randrange(9), some(e % 4), some(e % 3), None if day is None else datetime.date(2020, 1, 1) + datetime.timedelta(day), day, r.randrange(1, 8), some("turf" if e % 2 else "dirt"), some(1000 + 200 * (e % 5)), some(e % 4 + 1)))
    rows += rows[:40]  # rows that come twice
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/t")
    return spark.read.parquet(f"{tmp_path}/t")


def taken(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rows", [7, 60])
def test_bloodline_detail_is_the_same_in_slices_of_any_size(spark, tmp_path, monkeypatch, rows):
    df = frame(spark, tmp_path)
    want = taken(B.build(df, ["bloodline_detail"]))  # windows by key: the input is small
    monkeypatch.setattr(hot, "DEAL_FROM", 100)
    monkeypatch.setattr(slices, "SLICE_ROWS", rows)
    got = B.build(df, ["bloodline_detail"])
    assert taken(got) == want and len(want) == df.count()


def test_copies_in_one_frame_do_not_meet(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    df = frame(spark, tmp_path).withColumn(COPY, F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("outcome", F.expr("outcome % 4 + copy_no"))
    want = taken(B.build(df, ["bloodline_detail"]))
    monkeypatch.setattr(hot, "DEAL_FROM", 100)
    monkeypatch.setattr(slices, "SLICE_ROWS", 50)
    assert taken(B.build(df, ["bloodline_detail"])) == want


def test_no_row_is_dealt_by_a_key_of_few_values_alone(spark, tmp_path, monkeypatch):
    df = frame(spark, tmp_path)
    monkeypatch.setattr(hot, "DEAL_FROM", 100)
    monkeypatch.setattr(slices, "SLICE_ROWS", 50)
    plan = B.build(df, ["bloodline_detail"])._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"Window \[.*", plan)
    assert "percentile" not in plan
    assert all("__slice" in w.split("windowspecdefinition(", 1)[1].split(" ASC")[0] for w in windows if "entity" in w or "__place" in w)


def test_spread_of_flags_is_that_of_the_flags(spark):
    from pyspark.sql import functions as F

    rows = [(i, j % 3 == 0 and j < i) for i in range(1, 30) for j in range(i)]
    df = spark.createDataFrame([(i, int(x)) for i, x in rows], "i int, x int").groupBy("i")
    df = df.agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.stddev_samp("x").alias("d"), *[F.percentile("x", F.lit(q)).alias(f"q{k}") for k, q in enumerate((0.25, 0.5, 0.75))])
    df = df.select("*", B._flag_std("s", "n").alias("d_"), *[B._flag_quantile("s", "n", q).alias(f"q{k}_") for k, q in enumerate((0.25, 0.5, 0.75))])
    for r in df.collect():
        assert r["n"] == 1 or abs(r["d"] - r["d_"]) < 1e-12
        assert all(abs(r[f"q{k}"] - r[f"q{k}_"]) < 1e-12 for k in range(3))
