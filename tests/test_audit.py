"""The point-in-time audit finds what looks ahead and passes what doesn't."""

from pyspark.sql import functions as F

from hindcast.operators import audit as A
from hindcast.operators.calendar import before_group, global_before, variant_index
from hindcast.operators.history import COPY, ewm, history, past
from hindcast.operators.relative import standing, totals

from .conftest import assert_same

KEYS = ["group_id", "line"]
ORDER = ["day_no", "group_id", "line"]


def _runs(spark):
    i = F.col("id")
    return spark.range(400).select(
        (i / 4).cast("long").alias("group_id"), (i % 4).alias("line"), (i * 7 % 23).alias("entity"), (i % 3).alias("venue"), (i / 20).cast("int").alias("day_no"),
        F.date_add(F.lit("2024-01-01"), (i / 20).cast("int")).alias("day"), (i * 31 % 9 + 1).cast("int").alias("outcome"), (i * 17 % 41 / 3.0).alias("time"),
    )


def _changes(spark, parts, **more):
    noise = {"outcome": F.col("outcome") + 2, "time": F.col("time") * 3}
    cut = F.lit("2024-01-11").cast("date")
    out = A.future_changes(_runs(spark), KEYS, ["group_id", "entity"], "day", cut, noise, parts, **more).collect()
    return {r["name"]: (r["changed"], r["compared"]) for r in out}


def test_histories_do_not_move_and_leaks_do(spark):
    parts = {
        "mean": lambda d: history(d, "entity", ORDER, m=past("mean", "outcome"), e=ewm("time", 0.3)),
        "venue": lambda d: history(d, "venue", ORDER, m=past("sum", "time"), q=past("quantile", "time")),
        "groups": lambda d: before_group(d, "venue", "group_id", "day", {"n": F.lit(1), "s": F.col("time")}),
        "all": lambda d: global_before(d, "day", {"s": F.col("time")}),
        "level": lambda d: variant_index(d, "venue", ORDER, "time"),
        "standing": lambda d: standing(d, "group_id", "time"),
        "whole_mean": lambda d: totals(d, "entity", a=F.avg("time")),
        "late_only": lambda d: d.withColumn("x", F.col("outcome")),
        "next_day": lambda d: d.join(d.groupBy(COPY, (F.col("day_no") - 1).alias("day_no")).agg(F.sum("outcome").alias("next")), [COPY, "day_no"], "left"),
        "lost": lambda d: d.withColumn("x", F.lit(1)).filter((F.col(COPY) == 0) | (F.col("line") != 2)),
    }
    got = _changes(spark, parts, at_a_time=1)
    assert {n for n, (changed, _) in got.items() if changed} == {"whole_mean", "next_day", "lost"}
    assert got["whole_mean"] == (200, 200) and got["next_day"] == (20, 200) and got["lost"] == (50, 200)


def test_parts_of_one_pass_do_not_see_each_other(spark):
    same = lambda d: history(d, "entity", ORDER, m=past("mean", "outcome"))
    leak = lambda d: totals(d, "entity", m=F.avg("time"))
    assert _changes(spark, {"a": same, "b": leak, "c": same}, at_a_time=3) == {"a": (0, 200), "b": (200, 200), "c": (0, 200)}


def test_copies_of_a_frame_give_what_each_gives_alone(spark):
    runs = _runs(spark)
    other = runs.withColumn("time", F.col("time") + F.col("line"))
    both = runs.withColumn(COPY, F.lit(0)).unionByName(other.withColumn(COPY, F.lit(1)))

    def features(d):
        d = history(d, "venue", ORDER, m=past("mean", "time"))
        return global_before(before_group(d, "venue", "group_id", "day", {"n": F.col("line")}), "day", {"s": F.col("line")})

    out = features(both)
    assert_same(out.filter(F.col(COPY) == 0).drop(COPY), features(runs), KEYS)
    assert_same(out.filter(F.col(COPY) == 1).drop(COPY), features(other), KEYS)
