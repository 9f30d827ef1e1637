"""Keys of any length, caps that skip, first of several new rows, quantiles without a buffer, hot keys in small files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.functions import scalars as S
from hindcast.operators.asof import insert_absent
from hindcast.operators.decide import day_cap
from hindcast.operators.quantiles import exact_quantiles
from hindcast.plans import hot
from hindcast.plans.features import attribute_features


def test_padding_never_cuts(spark):
    df = spark.createDataFrame([("7",), ("123456",), (None,)], "k string")
    assert [r[0] for r in df.select(S.pad("k", 4)).collect()] == ["0007", "123456", None]
    nine = spark.createDataFrame([([100, 3],)], "s array<int>")
    assert nine.select(S.combination("s", False, 2)).first()[0] == "03100"
    clock = spark.createDataFrame([("1234",), ("12345",), ("34",)], "t string").select(S.clock_seconds("t")).collect()
    assert [r[0] for r in clock] == [83.4, None, 3.4]


def test_long_codes_join_their_own_person_only(spark):
    runs = spark.createDataFrame([(123451,), (123459,)], "p int").withColumn("day", F.lit("2020-01-01").cast("date"))
    people = spark.createDataFrame([(123451, 1), (123452, 2)], "code int, belongs int").withColumns({c: F.lit("1990-01-01").cast("date") for c in ("born", "licensed")})
    got = attribute_features(runs, people, "p", "x").collect()
    assert {(r["p"], r["x_belong_code"]) for r in got} == {(123451, 1), (123459, 0)} and len(got) == 2


def test_day_cap_skips_and_goes_on(spark):
    rows = [("d", 1, 1, 2000), ("d", 1, 2, 2000), ("d", 2, 3, 500), ("d", 3, 4, 600), ("d", 4, 5, 0), ("d", 5, 6, 500), ("e", 9, 7, 4000)]
    df = spark.createDataFrame(rows, "day string, race int, i int, amount int")
    assert {r["i"]: r["bought"] for r in day_cap(df, "day", ["i"], "amount", 3000).collect()} == {1: 1, 2: 0, 3: 1, 4: 0, 5: 0, 6: 1, 7: 0}
    got = day_cap(df, "day", ["race", "i"], "amount", 4700, "race", 2500).collect()
    assert {r["i"]: r["bought"] for r in got} == {1: 1, 2: 0, 3: 1, 4: 1, 5: 0, 6: 1, 7: 0}


def test_only_the_first_new_row_of_a_key_is_inserted(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "d"), (2, "c")], "k int, v string")
    assert sorted(map(tuple, insert_absent(old, new, ["k"]).collect())) == [(1, "a"), (2, "c")]


@pytest.mark.parametrize("last", [5, 10**6])
def test_exact_quantiles(spark, last):
    rng = np.random.default_rng(1)
    x, y = rng.lognormal(size=500), rng.integers(0, 3, 500).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, None)], "x double, y double")
    got = exact_quantiles(df, {f"{c}{q}": (F.col(c), q) for c in "xy" for q in (0.0, 0.05, 0.5, 0.613, 1.0)} | {"none": (F.lit(None), 0.5)}, last)
    for c, v in (("x", x), ("y", y)):
        for q in (0.0, 0.05, 0.5, 0.613, 1.0):
            assert abs(got[f"{c}{q}"] - np.quantile(v, q)) < 1e-12
    assert got["none"] is None


def test_hot_keys_in_a_small_file_are_found_once(spark, tmp_path):
    path = str(tmp_path / "one-key")
    spark.range(6_000_000).select(F.lit(1).alias("k")).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    found = hot.hot_keys(df, ["k"])
    assert found is not None and found.biggest == 6_000_000
    before = len(hot._FOUND)
    assert hot.hot_keys(df.withColumn("x", F.lit(2) * F.col("k")), ["k"]) is found and len(hot._FOUND) == before
