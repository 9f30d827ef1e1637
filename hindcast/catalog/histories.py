"""History windows over the entries view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import gap_category, ratio, season
from ..operators.calendar import (
    attach, before_group, collapse, global_before, global_trailing_rows, smoothed, trailing_days, variant_index,
)
from ..operators.history import ewm, ewm_recursive, history, lag, last_k, past, seq
from ..operators.relative import rank, top_k, totals
from ..plans.registry import query
from ..sources.tables import entries, oracle

KEY = ["group_id", "line", "entity", "person_a"]
ENTITY = ["day_no", "group_id", "line", "person_a"]
PERSON = ["day_no", "group_id", "line", "entity"]
K = "group_id, line, entity, person_a"
WE = "(PARTITION BY entity ORDER BY day_no, group_id, line, person_a"
PAST = WE + " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def LAST(k):
    return f"{WE} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


def DAYS(key, d):
    return f"(PARTITION BY {key} ORDER BY day_no RANGE BETWEEN {d} PRECEDING AND 1 PRECEDING)"


def _pick(df: DataFrame, **cols) -> DataFrame:
    return df.select(*KEY, *[c.alias(n) for n, c in cols.items()])


def win():
    return (F.col("outcome") == 1).cast("int")


def top3():
    return (F.col("outcome") <= 3).cast("int")


@query("w00_slice_top3_by_person_form", oracle(f"""
SELECT {K}, runs, wins, win_rate, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY win_rate DESC, line, entity, person_a) AS pos FROM (
    SELECT {K}, runs, wins, coalesce(round(wins / nullif(runs, 0), 6), 0) AS win_rate FROM (
      SELECT {K}, count(*) OVER {DAYS('person_a', 365)} AS runs,
             CAST(coalesce(count(*) FILTER (outcome = 1) OVER {DAYS('person_a', 365)}, 0) AS BIGINT) AS wins FROM entries)))
WHERE pos <= 3"""))
def w00(spark, sf):
    """Flagship: 365-day win rate of the person, then the best three rows of every group."""
    df = trailing_days(entries(spark, sf), "person_a", "day", {"runs": F.lit(1), "wins": win()}, [365])
    df = _pick(df, runs=F.col("runs_365d"), wins=F.col("wins_365d"))
    df = df.withColumn("win_rate", F.coalesce(F.round(F.try_divide("wins", "runs"), 6), F.lit(0.0)))
    w = Window.partitionBy("group_id").orderBy(F.col("win_rate").desc(), "line", "entity", "person_a")
    return df.withColumn("pos", F.row_number().over(w)).filter("pos <= 3")


@query("w01_lags", oracle(f"""
SELECT {K}, coalesce(lag(outcome, 1) OVER {WE}), 3) AS lag1, lag(outcome, 2) OVER {WE}) AS lag2,
  lag(outcome, 3) OVER {WE}) AS lag3, lag(outcome, 4) OVER {WE}) AS lag4, lag(outcome, 5) OVER {WE}) AS lag5,
  coalesce(lag(flag, 1) OVER {WE}), 'missing') AS lag_flag FROM entries"""))
def w01(spark, sf):
    cols = {f"lag{i}": lag("outcome", i, default=3 if i == 1 else None) for i in range(1, 6)}
    df = history(entries(spark, sf), "entity", ENTITY, **cols, lag_flag=lag("flag", default="missing"))
    return df.select(*KEY, *cols, "lag_flag")


@query("w02_prior_count", oracle(f"SELECT {K}, row_number() OVER {WE}) - 1 AS runs FROM entries"))
def w02(spark, sf):
    return history(entries(spark, sf), "entity", ENTITY, runs=seq()).select(*KEY, "runs")


@query("w03_interval", oracle(f"""
SELECT *, CASE WHEN interval IS NULL THEN 'First' WHEN interval <= 7 THEN 'Rento' WHEN interval <= 30 THEN 'Short'
  WHEN interval <= 90 THEN 'Medium' WHEN interval <= 180 THEN 'Long' ELSE 'Rest' END AS category FROM (
  SELECT {K}, day_no - lag(day_no) OVER {WE}) AS interval FROM entries)"""))
def w03(spark, sf):
    df = history(entries(spark, sf), "entity", ENTITY, prev=lag("day_no"))
    gap = F.col("day_no") - F.col("prev")
    return _pick(df, interval=gap, category=gap_category(gap))


@query("w04_trailing_mean", oracle(f"""
SELECT {K}, round(avg(outcome) OVER {LAST(5)}, 6) AS mean5, round(avg(outcome) OVER {LAST(3)}, 6) AS mean3 FROM entries"""))
def w04(spark, sf):
    df = history(entries(spark, sf), "entity", ENTITY, m5=last_k("mean", "outcome", 5), m3=last_k("mean", "outcome", 3))
    return _pick(df, mean5=F.round("m5", 6), mean3=F.round("m3", 6))


@query("w05_trailing_stats", oracle(f"""
SELECT {K}, CASE WHEN count(outcome) OVER {LAST(5)} >= 3 THEN round(stddev_samp(outcome) OVER {LAST(5)}, 6) END AS std5,
  max(qty) OVER {LAST(5)} AS max5, min(qty) OVER {LAST(5)} AS min5, CAST(sum(qty) OVER {LAST(5)} AS BIGINT) AS sum5,
  count(qty) OVER {LAST(5)} AS n5 FROM entries"""))
def w05(spark, sf):
    df = history(
        entries(spark, sf), "entity", ENTITY, std5=last_k("std", "outcome", 5, min_n=3), max5=last_k("max", "qty", 5),
        min5=last_k("min", "qty", 5), sum5=last_k("sum", "qty", 5), n5=last_k("count", "qty", 5),
    )
    return df.select(*KEY, F.round("std5", 6).alias("std5"), "max5", "min5", "sum5", "n5")


@query("w06_trailing_quantiles", oracle(f"""
SELECT {K}, round(quantile_cont(qty, 0.5) OVER {LAST(10)}, 6) AS med10,
  CASE WHEN count(qty) OVER {LAST(50)} >= 8 THEN
    round(quantile_cont(qty, 0.75) OVER {LAST(50)} - quantile_cont(qty, 0.25) OVER {LAST(50)}, 6) END AS iqr50 FROM entries"""))
def w06(spark, sf):
    df = history(
        entries(spark, sf), "entity", ENTITY, med10=last_k("quantile", "qty", 10),
        q3=last_k("quantile", "qty", 50, min_n=8, q=0.75), q1=last_k("quantile", "qty", 50, min_n=8, q=0.25),
    )
    return _pick(df, med10=F.round("med10", 6), iqr50=F.round(F.col("q3") - F.col("q1"), 6))


@query("w07_expanding_stats", oracle(f"""
SELECT {K}, round(avg(outcome) OVER {PAST}, 6) AS mean, CAST(sum(qty) OVER {PAST} AS BIGINT) AS total, count(qty) OVER {PAST} AS n,
  min(qty) OVER {PAST} AS lo, max(qty) OVER {PAST} AS hi, round(stddev_samp(outcome) OVER {PAST}, 6) AS std FROM entries"""))
def w07(spark, sf):
    df = history(
        entries(spark, sf), "entity", ENTITY, mean=past("mean", "outcome"), total=past("sum", "qty"), n=past("count", "qty"),
        lo=past("min", "qty"), hi=past("max", "qty"), std=past("std", "outcome"),
    )
    return _pick(df, mean=F.round("mean", 6), total=F.col("total"), n=F.col("n"), lo=F.col("lo"), hi=F.col("hi"), std=F.round("std", 6))


@query("w08_expanding_median_with_fallback", oracle(f"""
SELECT {K}, round(coalesce(m1, m2), 6) AS median FROM (
 SELECT {K}, CASE WHEN count(qty) OVER {PAST} >= 5 THEN quantile_cont(qty, 0.5) OVER {PAST} END AS m1 FROM entries)
 JOIN (SELECT {K}, quantile_cont(qty, 0.5) OVER (PARTITION BY person_a ORDER BY day_no, group_id, line, entity
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m2 FROM entries) USING ({K})"""))
def w08(spark, sf):
    """Median of all earlier values; until the entity has five, that of its person."""
    from ..operators.quantiles import expanding_quantile

    df = expanding_quantile(entries(spark, sf), "entity", ENTITY, "qty", 0.5, "m1", min_n=5)
    df = expanding_quantile(df, "person_a", PERSON, "qty", 0.5, "m2")
    return _pick(df, median=F.round(F.coalesce("m1", "m2"), 6))


@query("w09_cumulative_minus_current", oracle(f"""
SELECT {K}, CAST(coalesce(sum(CAST(outcome = 1 AS INTEGER)) OVER {PAST}, 0) AS BIGINT) AS wins, count(*) OVER {PAST} AS n FROM entries"""))
def w09(spark, sf):
    return history(entries(spark, sf), "entity", ENTITY, wins=past("sum", win(), default=0), n=past("count")).select(*KEY, "wins", "n")


def _rates(df, tag):
    return {
        f"n_{tag}": F.col(f"n_{tag}"),
        f"win_{tag}": F.round(F.try_divide(f"win_{tag}", f"n_{tag}"), 6),
        f"top3_{tag}": F.round(F.try_divide(f"top3_{tag}", f"n_{tag}"), 6),
    }


def _rate_sql(key, d):
    w = DAYS(key, d)
    return (f"count(*) OVER {w} AS n_{d}d, round(count(*) FILTER (outcome = 1) OVER {w} / nullif(count(*) OVER {w}, 0), 6) AS win_{d}d,"
            f" round(count(*) FILTER (outcome <= 3) OVER {w} / nullif(count(*) OVER {w}, 0), 6) AS top3_{d}d")


def form():
    return {"n": F.lit(1), "win": win(), "top3": top3()}


@query("w10_days365_rates", oracle(f"""
SELECT {K}, {_rate_sql('person_a', 365)}, round(CAST(sum(outcome) OVER {DAYS('person_a', 365)} AS BIGINT) / nullif(count(*) OVER {DAYS('person_a', 365)}, 0), 6) AS avg_365d
FROM entries"""))
def w10(spark, sf):
    df = trailing_days(entries(spark, sf), "person_a", "day", {**form(), "sum": F.col("outcome")}, [365])
    return _pick(df, **_rates(df, "365d"), avg_365d=F.round(F.try_divide("sum_365d", "n_365d"), 6))


@query("w11_days180_365_both_persons", oracle(f"""
SELECT {K}, {_rate_sql('person_a', 180)}, {_rate_sql('person_a', 365)} FROM entries"""))
def w11(spark, sf):
    df = trailing_days(entries(spark, sf), "person_a", "day", form(), [180, 365])
    return _pick(df, **_rates(df, "180d"), **_rates(df, "365d"))


@query("w12_days30_60_two_persons", oracle(f"""
SELECT {K}, {_rate_sql('person_a', 30)}, {_rate_sql('person_a', 60)},
 count(*) OVER {DAYS('person_b', 30)} AS b_n_30d, count(*) OVER {DAYS('person_b', 60)} AS b_n_60d FROM entries"""))
def w12(spark, sf):
    df = trailing_days(entries(spark, sf), "person_a", "day", form(), [30, 60])
    df = trailing_days(df, "person_b", "day", {"b_n": F.lit(1)}, [30, 60])
    return _pick(df, **_rates(df, "30d"), **_rates(df, "60d"), b_n_30d=F.col("b_n_30d"), b_n_60d=F.col("b_n_60d"))


@query("w13_days365_by_class", oracle(f"SELECT {K}, {_rate_sql('entity, flag', 365)} FROM entries"))
def w13(spark, sf):
    df = trailing_days(entries(spark, sf), ["entity", "flag"], "day", form(), [365])
    return _pick(df, **_rates(df, "365d"))


def _group_sql(key):
    return f"""cells AS (SELECT {key}, group_id, day_no, count(*) AS c, count(*) FILTER (outcome = 1) AS w FROM entries GROUP BY ALL),
    prior AS (SELECT {key}, group_id, CAST(coalesce(sum(c) OVER q, 0) AS BIGINT) AS n, CAST(coalesce(sum(w) OVER q, 0) AS BIGINT) AS wins FROM cells
      WINDOW q AS (PARTITION BY {key} ORDER BY day_no, group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("w14_before_group", oracle(f"SELECT {K}, n, wins FROM entries JOIN prior USING (person_a, group_id)", _group_sql("person_a")))
def w14(spark, sf):
    df = before_group(entries(spark, sf), "person_a", "group_id", "day", {"n": F.lit(1), "wins": win()})
    return _pick(df, n=F.col("n_before"), wins=F.col("wins_before"))


@query("w15_before_group_in_context", oracle(f"SELECT {K}, n, wins FROM entries JOIN prior USING (person_a, flag, group_id)", _group_sql("person_a, flag")))
def w15(spark, sf):
    df = before_group(entries(spark, sf), ["person_a", "flag"], "group_id", "day", {"n": F.lit(1), "wins": win()})
    return _pick(df, n=F.col("n_before"), wins=F.col("wins_before"))


BEFORE_DAY = "(PARTITION BY {} ORDER BY day_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("w16_before_day_smoothed", oracle(f"""
SELECT {K}, n, round((wins + 10.0 * 0.08) / (n + 10.0), 6) AS rate FROM (SELECT {K}, count(*) OVER {BEFORE_DAY.format('person_a')} AS n,
 count(*) FILTER (outcome = 1) OVER {BEFORE_DAY.format('person_a')} AS wins FROM entries)"""))
def w16(spark, sf):
    df = before_group(entries(spark, sf), "person_a", "group_id", "day", {"n": F.lit(1), "wins": win()}, grain="day")
    rate = smoothed(F.col("wins_before"), F.col("n_before"), F.lit(0.08), 10)
    return _pick(df, n=F.col("n_before"), rate=F.round(rate, 6))


EWM = """(SELECT sum(power({d}, p.pos0 - q.pos) * q.x) / sum(power({d}, p.pos0 - q.pos)) FROM seqd q
  WHERE q.entity = p.entity AND q.pos < p.pos AND q.x IS NOT NULL)"""


@query("w17_ewm_adjusted", oracle(f"""
SELECT {K}, round(num3 / den3, 6) AS ewm3, round(num5 / den5, 6) AS ewm5 FROM (
 SELECT p.{K.replace(', ', ', p.')}, sum(power(0.5, p.pos - q.pos) * q.x) AS num3, sum(power(0.5, p.pos - q.pos)) FILTER (q.x IS NOT NULL) AS den3,
   sum(power(2.0/3.0, p.pos - q.pos) * q.x) AS num5, sum(power(2.0/3.0, p.pos - q.pos)) FILTER (q.x IS NOT NULL) AS den5
 FROM seqd p LEFT JOIN seqd q ON q.entity = p.entity AND q.pos < p.pos GROUP BY ALL)""",
 f"seqd AS (SELECT {K}, CASE WHEN flag <> 'N' THEN outcome END AS x, row_number() OVER {WE}) AS pos FROM entries)"))
def w17(spark, sf):
    """Span 3 and 5 over earlier outcomes; rows of one class have none, which leaves gaps."""
    x = F.when(F.col("flag") != "N", F.col("outcome"))
    df = history(entries(spark, sf), "entity", ENTITY, e3=ewm(x, 0.5), e5=ewm(x, 1 / 3))
    return _pick(df, ewm3=F.round("e3", 6), ewm5=F.round("e5", 6))


@query("w18_ewm_recursive", oracle(f"""
SELECT {K}, round(s, 6) AS decayed FROM (
 SELECT p.{K.replace(', ', ', p.')}, sum(power(0.8, p.pos - 1 - q.pos) * q.x * CASE WHEN q.pos = 1 THEN 1.0 ELSE 0.2 END) AS s
 FROM seqd p LEFT JOIN seqd q ON q.entity = p.entity AND q.pos < p.pos GROUP BY ALL)""",
 f"seqd AS (SELECT {K}, outcome AS x, row_number() OVER {WE}) AS pos FROM entries)"))
def w18(spark, sf):
    df = history(entries(spark, sf), "entity", ENTITY, s=ewm_recursive("outcome", 0.2))
    return _pick(df, decayed=F.round("s", 6))


@query("w19_slope5", oracle(f"""
SELECT {K}, round((2.0 * lag(outcome, 1) OVER {WE}) + lag(outcome, 2) OVER {WE}) - lag(outcome, 4) OVER {WE}) - 2 * lag(outcome, 5) OVER {WE})) / 10, 6) AS slope
FROM entries"""))
def w19(spark, sf):
    df = history(entries(spark, sf), "entity", ENTITY, **{f"l{i}": lag("outcome", i) for i in (1, 2, 4, 5)})
    return _pick(df, slope=F.round(F.expr("(2.0D * l1 + l2 - l4 - 2 * l5) / 10"), 6))


@query("w20_weighted_last5", oracle(f"""
SELECT {K}, round(num / nullif(den, 0), 6) AS weighted FROM (SELECT {K},
 coalesce(l1, 0) * 1.0 + coalesce(l2, 0) * 0.5 + coalesce(l3, 0) * 0.25 + coalesce(l4, 0) * 0.125 + coalesce(l5, 0) * 0.06 AS num,
 CAST(l1 IS NOT NULL AS INT) * 1.0 + CAST(l2 IS NOT NULL AS INT) * 0.5 + CAST(l3 IS NOT NULL AS INT) * 0.25 + CAST(l4 IS NOT NULL AS INT) * 0.125
 + CAST(l5 IS NOT NULL AS INT) * 0.06 AS den FROM (SELECT {K}, {', '.join(f'CAST(lag(outcome, {i}) OVER {WE}) AS DOUBLE) AS l{i}' for i in range(1, 6))} FROM entries))"""))
def w20(spark, sf):
    weights = [1.0, 0.5, 0.25, 0.125, 0.06]  # fixed values
    df = history(entries(spark, sf), "entity", ENTITY, **{f"l{i}": lag("outcome", i) for i in range(1, 6)})
    num = sum((F.coalesce(F.col(f"l{i}"), F.lit(0)) * w for i, w in enumerate(weights, 1)), F.lit(0.0))
    den = sum((F.col(f"l{i}").isNotNull().cast("int") * w for i, w in enumerate(weights, 1)), F.lit(0.0))
    return _pick(df, weighted=F.round(F.try_divide(num, den), 6))


@query("w27_expanding_mode", oracle(f"""
SELECT {K}, CASE WHEN a + n + r = 0 THEN 'N' WHEN a >= n AND a >= r THEN 'A' WHEN n >= r THEN 'N' ELSE 'R' END AS style FROM (
 SELECT {K}, count(*) FILTER (flag = 'A') OVER {PAST} AS a, count(*) FILTER (flag = 'N') OVER {PAST} AS n, count(*) FILTER (flag = 'R') OVER {PAST} AS r FROM entries)"""))
def w27(spark, sf):
    from ..operators.quantiles import expanding_mode

    df = expanding_mode(entries(spark, sf), "entity", ENTITY, "flag", ["A", "N", "R"], "style", default="N")
    return df.select(*KEY, "style")


@query("w28_sessions", oracle(f"""
SELECT {K}, session, row_number() OVER (PARTITION BY entity, session ORDER BY day_no, group_id, line, person_a) AS nth FROM (
 SELECT *, CAST(sum(fresh) OVER {WE} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (
  SELECT *, CASE WHEN day_no - lag(day_no) OVER {WE}) > 60 THEN 1 ELSE 0 END AS fresh FROM entries))"""))
def w28(spark, sf):
    df = history(entries(spark, sf), "entity", ENTITY, prev=lag("day_no"))
    df = df.withColumn("fresh", F.coalesce(F.col("day_no") - F.col("prev") > 60, F.lit(False)).cast("int"))
    df = history(df, "entity", ENTITY, before=past("sum", "fresh", default=0))
    df = df.withColumn("session", F.col("before") + F.col("fresh"))
    df = history(df, ["entity", "session"], ENTITY, nth=seq())
    return _pick(df, session=F.col("session"), nth=F.col("nth") + 1)


@query("w29_run_length", oracle(f"""
SELECT {K}, CAST(sum(change) OVER {WE} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM (
 SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) OVER {WE}) THEN 1 ELSE 0 END AS change FROM entries)"""))
def w29(spark, sf):
    """Run number of equal consecutive values."""
    df = history(entries(spark, sf), "entity", ENTITY, prev=lag("flag"))
    df = df.withColumn("change", (~F.col("flag").eqNullSafe(F.col("prev"))).cast("int"))
    df = history(df, "entity", ENTITY, before=past("sum", "change", default=0))
    return _pick(df, run=F.col("before") + F.col("change"))


@query("w30_masked_expanding_mean", oracle(f"""
SELECT {K}, round(avg(CASE WHEN qty >= 25 THEN outcome END) OVER {PAST}, 6) AS heavy_mean FROM entries"""))
def w30(spark, sf):
    df = history(entries(spark, sf), "entity", ENTITY, m=past("mean", F.when(F.col("qty") >= 25, F.col("outcome"))))
    return _pick(df, heavy_mean=F.round("m", 6))


PROFIT_SQL = "CASE WHEN outcome = 1 THEN qty * 100 ELSE -100 * (1 + disc) END"


@query("w31_running_total_drawdown", oracle(f"""
SELECT *, peak - equity AS drawdown FROM (SELECT {K}, equity, greatest(max(equity) OVER (PARTITION BY person_a ORDER BY day_no, group_id, line, entity ROWS UNBOUNDED PRECEDING), 0) AS peak
 FROM (SELECT *, CAST(sum({PROFIT_SQL}) OVER (PARTITION BY person_a ORDER BY day_no, group_id, line, entity ROWS UNBOUNDED PRECEDING) AS BIGINT) AS equity FROM entries))"""))
def w31(spark, sf):
    df = entries(spark, sf).withColumn("profit", F.when(F.col("outcome") == 1, F.col("qty") * 100).otherwise(F.lit(-100) * (1 + F.col("disc"))))
    df = history(df, "person_a", PERSON, before=past("sum", "profit", default=0))
    df = df.withColumn("equity", F.col("before") + F.col("profit"))
    df = history(df, "person_a", PERSON, high=past("max", "equity"))
    df = df.withColumn("peak", F.greatest(F.lit(0).cast("long"), F.col("high"), F.col("equity")))
    return _pick(df, equity=F.col("equity"), peak=F.col("peak"), drawdown=F.col("peak") - F.col("equity"))


@query("w32_forward_fill", oracle(f"""
SELECT {K}, last_value(CASE WHEN disc > 5 THEN qty END IGNORE NULLS) OVER {WE} ROWS UNBOUNDED PRECEDING) AS filled FROM entries"""))
def w32(spark, sf):
    df = entries(spark, sf).withColumn("x", F.when(F.col("disc") > 5, F.col("qty")))
    df = history(df, "entity", ENTITY, prev=past("last", "x"))
    return _pick(df, filled=F.coalesce("x", "prev"))


@query("w33_global_prior", oracle(f"""
SELECT {K}, n, round(wins / nullif(n, 0), 6) AS prior FROM (SELECT {K}, count(*) OVER d AS n, count(*) FILTER (outcome = 1) OVER d AS wins
 FROM entries WINDOW d AS (ORDER BY day_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""))
def w33(spark, sf):
    df = global_before(entries(spark, sf), "day", {"n": F.lit(1), "wins": win()})
    return _pick(df, n=F.col("n_before"), prior=F.round(F.try_divide("wins_before", "n_before"), 6))


@query("w34_global_baseline_z", oracle(f"""
SELECT {K}, round((qty - m) / s, 6) AS z_fixed, round((qty - rs / rn) / sqrt((rq - rs * rs / rn) / (rn - 1)), 6) AS z_recent FROM (
 SELECT {K}, qty, CAST(sum(qty) OVER d AS DOUBLE) AS rs, CAST(sum(qty * qty) OVER d AS DOUBLE) AS rq, CAST(nullif(count(*) OVER d, 0) AS DOUBLE) AS rn FROM entries
 WINDOW d AS (ORDER BY day_no RANGE BETWEEN 180 PRECEDING AND 1 PRECEDING)),
 (SELECT avg(qty) AS m, stddev_samp(qty) AS s FROM entries WHERE day <= DATE '1998-12-31')"""))
def w34(spark, sf):
    """z-score against a fixed baseline period and against the last 180 days of all rows."""
    df = entries(spark, sf)
    base = df.filter("day <= DATE '1998-12-31'").agg(F.avg("qty").alias("m"), F.stddev_samp("qty").alias("s"))
    df = global_trailing_rows(df, "day", {"n": F.lit(1.0), "q1": F.col("qty").cast("double"), "q2": (F.col("qty") * F.col("qty")).cast("double")}, 180)
    mean = F.col("q1_recent") / F.col("n_recent")
    var = F.try_divide(F.col("q2_recent") - F.try_divide(F.col("q1_recent") * F.col("q1_recent"), F.col("n_recent")), F.col("n_recent") - 1)
    df = df.join(F.broadcast(base))  # one row
    return _pick(df, z_fixed=F.round((F.col("qty") - F.col("m")) / F.col("s"), 6), z_recent=F.round(F.try_divide(F.col("qty") - mean, F.sqrt(var)), 6))


@query("w35_change_flags", oracle(f"""
SELECT {K}, CAST(coalesce(person_a <> l1, FALSE) AS INTEGER) AS changed, CAST(coalesce(person_a <> l1 AND person_a = l2, FALSE) AS INTEGER) AS returned,
 CAST(seen = 1 AS INTEGER) AS first_ever FROM (SELECT {K}, lag(person_a, 1) OVER {WE}) AS l1, lag(person_a, 2) OVER {WE}) AS l2,
 row_number() OVER (PARTITION BY entity, person_a ORDER BY day_no, group_id, line) AS seen FROM entries)"""))
def w35(spark, sf):
    df = history(entries(spark, sf), "entity", ENTITY, l1=lag("person_a", 1), l2=lag("person_a", 2))
    df = history(df, ["entity", "person_a"], ["day_no", "group_id", "line"], seen=seq())
    changed = F.coalesce(F.col("person_a") != F.col("l1"), F.lit(False))
    back = F.coalesce(changed & (F.col("person_a") == F.col("l2")), F.lit(False))
    return _pick(df, changed=changed.cast("int"), returned=back.cast("int"), first_ever=(F.col("seen") == 0).cast("int"))


@query("w36_intraday_trend", oracle(f"""
SELECT {K}, bias FROM entries JOIN (SELECT group_id, flag0, round(avg(top) OVER (PARTITION BY day_no, flag0 ORDER BY group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS bias FROM (
 SELECT group_id, day_no, min(flag) AS flag0, avg(qty) FILTER (outcome <= 3) AS top FROM entries GROUP BY ALL)) USING (group_id)"""))
def w36(spark, sf):
    """Mean of the leaders' value over earlier groups of the same day and condition."""
    df = entries(spark, sf)
    g = df.groupBy("group_id", "day_no").agg(F.min("flag").alias("flag0"), F.avg(F.when(F.col("outcome") <= 3, F.col("qty"))).alias("top"))
    g = history(g, ["day_no", "flag0"], "group_id", b=past("mean", "top"))
    return _pick(df.join(g.select("group_id", F.round("b", 6).alias("bias")), "group_id"), bias=F.col("bias"))


@query("w37_lag_of_group_statistic", oracle(f"""
SELECT {K}, round(lag(level) OVER {WE}), 6) AS prev_level FROM (SELECT *, avg(qty) OVER (PARTITION BY group_id) AS level FROM entries)"""))
def w37(spark, sf):
    df = totals(entries(spark, sf), "group_id", level=F.avg("qty"))
    return _pick(history(df, "entity", ENTITY, p=lag("level")), prev_level=F.round("p", 6))


@query("w38_laplace", oracle(f"""
SELECT {K}, round((s + 20 * coalesce(gs / nullif(gn, 0), 0.0)) / (n + 20), 6) AS rate FROM (SELECT {K}, count(*) OVER {BEFORE_DAY.format('person_a')} AS n, count(*) FILTER (outcome = 1) OVER {BEFORE_DAY.format('person_a')} AS s,
 count(*) OVER d AS gn, count(*) FILTER (outcome = 1) OVER d AS gs FROM entries WINDOW d AS (ORDER BY day_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""))
def w38(spark, sf):
    """Smoothed towards the rate of all earlier days (never the whole table's rate)."""
    df = trailing_days(entries(spark, sf), "person_a", "day", {"n": F.lit(1), "s": win()}, [None])
    df = global_before(df, "day", {"gn": F.lit(1), "gs": win()})
    prior = F.coalesce(F.try_divide("gs_before", "gn_before"), F.lit(0.0))
    return _pick(df, rate=F.round(smoothed(F.col("s_all"), F.col("n_all"), prior, 20), 6))


@query("w39_constant_prior", oracle(f"""
SELECT {K}, round((w + 10 * 0.08) / (n + 10), 6) AS win, round((t + 10 * 0.25) / (n + 10), 6) AS top3 FROM (
 SELECT {K}, count(*) OVER {PAST} AS n, count(*) FILTER (outcome = 1) OVER {PAST} AS w, count(*) FILTER (outcome <= 3) OVER {PAST} AS t FROM entries)"""))
def w39(spark, sf):
    df = history(entries(spark, sf), "entity", ENTITY, n=past("count"), w=past("sum", win(), default=0), t=past("sum", top3(), default=0))
    return _pick(df, win=F.round(smoothed(F.col("w"), F.col("n"), F.lit(0.08), 10), 6), top3=F.round(smoothed(F.col("t"), F.col("n"), F.lit(0.25), 10), 6))


@query("w40_hierarchical_smoothing", oracle(f"""
SELECT {K}, round((pw + 3 * ra + 2 * rb + 8 * g) / (pn + 13.0), 6) AS rate FROM (
 SELECT *, coalesce(aw / nullif(an, 0), g) AS ra, coalesce(bw / nullif(bn, 0), g) AS rb FROM (
 SELECT {K}, count(*) OVER p AS pn, count(*) FILTER (outcome = 1) OVER p AS pw, count(*) OVER a AS an, count(*) FILTER (outcome = 1) OVER a AS aw,
 count(*) OVER b AS bn, count(*) FILTER (outcome = 1) OVER b AS bw, coalesce(count(*) FILTER (outcome = 1) OVER d / nullif(count(*) OVER d, 0), 0) AS g
 FROM entries WINDOW p AS {BEFORE_DAY.format('person_a, flag')}, a AS {BEFORE_DAY.format('person_a')}, b AS {BEFORE_DAY.format('flag')},
 d AS (ORDER BY day_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""))
def w40(spark, sf):
    df = entries(spark, sf)
    for keys, t in ((["person_a", "flag"], "p"), (["person_a"], "a"), (["flag"], "b")):
        df = trailing_days(df, keys, "day", {f"{t}n": F.lit(1), f"{t}w": win()}, [None])
    df = global_before(df, "day", {"gn": F.lit(1), "gw": win()})
    g = F.coalesce(F.try_divide("gw_before", "gn_before"), F.lit(0.0))
    ra, rb = (F.coalesce(F.try_divide(f"{t}w_all", f"{t}n_all"), g) for t in "ab")
    rate = (F.col("pw_all") + 3 * ra + 2 * rb + 8 * g) / (F.col("pn_all") + 13.0)
    return _pick(df, rate=F.round(rate, 6))


@query("w41_momentum", oracle(f"""
SELECT {K}, round(count(*) FILTER (outcome = 1) OVER s / nullif(count(*) OVER s, 0) - count(*) FILTER (outcome = 1) OVER l / nullif(count(*) OVER l, 0), 6) AS momentum
FROM entries WINDOW s AS {DAYS('person_a', 60)}, l AS {DAYS('person_a', 365)}"""))
def w41(spark, sf):
    df = trailing_days(entries(spark, sf), "person_a", "day", {"n": F.lit(1), "w": win()}, [60, 365])
    return _pick(df, momentum=F.round(F.try_divide("w_60d", "n_60d") - F.try_divide("w_365d", "n_365d"), 6))


@query("w42_speed_index", oracle(f"""
SELECT {K}, round(avg(idx) OVER {LAST(5)}, 5) AS idx_mean5, round(max(idx) OVER {LAST(5)}, 5) AS idx_max5 FROM (
 SELECT *, CASE WHEN s > 0 THEN greatest(-10, least(10, (m - qty) / s)) END AS idx FROM (SELECT *, CASE WHEN count(*) OVER c >= 30 THEN avg(qty) OVER c END AS m,
  CASE WHEN count(*) OVER c >= 30 THEN stddev_samp(qty) OVER c END AS s FROM entries WINDOW c AS (PARTITION BY person_a, flag ORDER BY day_no, group_id, line, entity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""))
def w42(spark, sf):
    """Standardised value against earlier rows of its condition, then last-five form of the entity."""
    df = history(entries(spark, sf), ["person_a", "flag"], PERSON, m=past("mean", "qty", min_n=30), s=past("std", "qty", min_n=30))
    z = F.try_divide(F.col("m") - F.col("qty"), F.col("s"))
    df = df.withColumn("idx", F.when(z.isNotNull(), F.greatest(F.lit(-10.0), F.least(F.lit(10.0), z))))
    df = history(df, "entity", ENTITY, a=last_k("mean", "idx", 5), b=last_k("max", "idx", 5))
    return _pick(df, idx_mean5=F.round("a", 5), idx_max5=F.round("b", 5))


@query("w43_reliability", oracle(f"""
SELECT {K}, round(w / nullif(n, 0) * sqrt(n / (n + 5.0)), 6) AS rate FROM (SELECT {K}, count(*) OVER {PAST} AS n, count(*) FILTER (outcome = 1) OVER {PAST} AS w FROM entries)"""))
def w43(spark, sf):
    df = history(entries(spark, sf), "entity", ENTITY, n=past("count"), w=past("sum", win(), default=0))
    return _pick(df, rate=F.round(F.try_divide("w", "n") * F.sqrt(F.col("n") / (F.col("n") + 5.0)), 6))


@query("w50_condition_variant", oracle(f"""
SELECT group_id, round(r - l, 6) AS variant, round(rm - lm, 6) AS variant_robust, round(s / sqrt(n), 6) AS uncertainty, round(1 / (1 + s / sqrt(n)), 6) AS confidence FROM (
 SELECT group_id, avg(v) OVER r10 AS r, quantile_cont(v, 0.5) OVER r10 AS rm, stddev_samp(v) OVER r10 AS s, count(v) OVER r10 AS n,
  avg(v) OVER p AS l, quantile_cont(v, 0.5) OVER r50 AS lm FROM g WINDOW r10 AS (PARTITION BY flag0 ORDER BY day_no, group_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
  r50 AS (PARTITION BY flag0 ORDER BY day_no, group_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), p AS (PARTITION BY flag0 ORDER BY day_no, group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
 "g AS (SELECT group_id, day_no, min(flag) AS flag0, avg(qty) AS v FROM entries GROUP BY ALL)"))
def w50(spark, sf):
    g = entries(spark, sf).groupBy("group_id", "day_no").agg(F.min("flag").alias("flag0"), F.avg("qty").alias("v"))
    out = variant_index(g, "flag0", ["day_no", "group_id"], "v")
    return out.select("group_id", *[F.round(c, 6).alias(c) for c in ("variant", "variant_robust", "uncertainty", "confidence")])


@query("w51_change_since_last", oracle(f"""
SELECT {K}, qty - lag(qty) OVER {WE}) AS diff, abs(qty - lag(qty) OVER {WE})) AS size FROM entries"""))
def w51(spark, sf):
    df = history(entries(spark, sf), "entity", ENTITY, p=lag("qty"))
    d = F.col("qty") - F.col("p")
    return _pick(df, diff=d, size=F.abs(d))


@query("w52_career_high", oracle(f"SELECT {K}, CAST(coalesce(qty > max(qty) OVER {PAST}, FALSE) AS INTEGER) AS high FROM entries"))
def w52(spark, sf):
    df = history(entries(spark, sf), "entity", ENTITY, m=past("max", "qty"))
    return _pick(df, high=F.coalesce(F.col("qty") > F.col("m"), F.lit(False)).cast("int"))
