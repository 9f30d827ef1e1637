"""Filters, cleaning, binning, targets and weights."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import scalars as S
from ..operators import clean
from ..operators.history import history, lag
from ..operators.metrics import quantile_bin, quantile_edges
from ..operators.relative import rank, totals
from ..plans.hot import sized_broadcast
from ..plans.registry import query
from ..sources.tables import entries, oracle, table, with_price
from .histories import K, KEY, _pick

RACE = "race AS (SELECT *, strftime(day, '%Y') || chr(CAST(65 + person_b % 5 AS INTEGER)) || CASE WHEN line < 10 THEN '0' ELSE '' END || line || '-' || group_id AS race_id FROM entries)"


def _races(spark, sf):
    code = F.char(F.lit(65) + F.col("person_b") % 5)
    return entries(spark, sf).withColumn("race_id", F.concat(F.date_format("day", "yyyy"), code, S.pad("line", 2), F.lit("-"), F.col("group_id").cast("string")))


@query("p01_organisation_filter", oracle(f"SELECT {K}, race_id FROM race WHERE substr(race_id, 5, 1) IN ('A', 'C')", RACE))
def p01(spark, sf):
    return clean.by_organisation(_races(spark, sf), "race_id", ["A", "C"]).select(*KEY, "race_id")


@query("p02_organisation_flags", oracle(f"SELECT {K}, CAST(substr(race_id, 5, 1) = 'A' AS INTEGER) AS is_central, CAST(substr(race_id, 5, 1) IN ('B', 'C') AS INTEGER) AS is_regional FROM race", RACE))
def p02(spark, sf):
    org = F.substring("race_id", 5, 1)
    return _pick(_races(spark, sf), is_central=(org == "A").cast("int"), is_regional=org.isin("B", "C").cast("int"))


@query("p03_organisation_counts", oracle("SELECT substr(race_id, 5, 1) AS org, count(*) AS n, count(DISTINCT group_id) AS groups, count(*) FILTER (outcome = 1) AS winners FROM race GROUP BY 1", RACE))
def p03(spark, sf):
    return _races(spark, sf).groupBy(F.substring("race_id", 5, 1).alias("org")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("group_id").alias("groups"), F.count_if(F.col("outcome") == 1).alias("winners")
    )


@query("p04_p34_time_split", oracle("SELECT CASE WHEN year(day) < 1999 THEN 'train' WHEN year(day) = 1999 THEN 'valid' ELSE 'test' END AS split, count(*) AS n FROM entries WHERE year(day) BETWEEN 1996 AND 2000 GROUP BY 1"))
def p04(spark, sf):
    df = clean.years(entries(spark, sf), "day", 1996, 2000, holdout=2001)
    y = F.year("day")
    return df.groupBy(F.when(y < 1999, "train").when(y == 1999, "valid").otherwise("test").alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("p05_finished_or_future", oracle(f"SELECT {K} FROM (SELECT *, CASE WHEN flag <> 'N' THEN outcome END AS res FROM entries) WHERE res IS NOT NULL OR day >= DATE '2001-01-01'"))
def p05(spark, sf):
    df = entries(spark, sf).withColumn("res", F.when(F.col("flag") != "N", F.col("outcome")))
    return clean.finished_or_future(df, "res", "day", "2001-01-01").select(*KEY)


@query("p06_p07_sentinels", oracle(f"""
SELECT {K}, CASE WHEN qty = 50 OR qty < 3 THEN (SELECT quantile_cont(qty, 0.5) FROM entries WHERE NOT (qty = 50 OR qty < 3)) ELSE qty END AS weight,
 CASE WHEN disc >= 9 THEN 0 ELSE disc END AS diff, round(CASE WHEN tax = 0 THEN (SELECT avg(tax) FROM entries WHERE tax <> 0) ELSE tax END, 6) AS impost, nullif(line, 1) AS number FROM entries"""))
def p06(spark, sf):
    df = entries(spark, sf).select(*KEY, F.col("qty").alias("weight"), F.col("disc").alias("diff"), F.col("tax").alias("impost"), F.col("line").alias("number"))
    df = clean.sentinels(df, [
        clean.Sentinel("weight", (F.col("weight") == 50) | (F.col("weight") < 3), "median", 470),
        clean.Sentinel("diff", F.col("diff") >= 9, "zero"),
        clean.Sentinel("impost", F.col("impost") == 0, "mean", 55),
        clean.Sentinel("number", F.col("number") == 1, "null"),
    ])
    return df.withColumn("impost", F.round("impost", 6))


@query("p08_p09_p10_impute", oracle(f"""
SELECT {K}, CAST(x IS NULL AS INTEGER) AS x_is_missing, coalesce(x, (SELECT quantile_cont(x, 0.5) FROM m)) AS x, coalesce(y, 0) AS y FROM m""",
 f"m AS (SELECT {K}, CASE WHEN flag <> 'A' THEN qty END AS x, CASE WHEN disc > 2 THEN disc END AS y FROM entries)"))
def p08(spark, sf):
    df = entries(spark, sf).select(*KEY, F.when(F.col("flag") != "A", F.col("qty")).alias("x"), F.when(F.col("disc") > 2, F.col("disc")).alias("y"))
    return clean.impute(clean.missing_flags(df, ["x"]), ["x"], ["y"])


@query("p11_neutral_fill", oracle(f"SELECT {K}, coalesce(CASE WHEN flag <> 'N' THEN outcome END, (count(*) OVER (PARTITION BY group_id) + 1) / 2.0) AS mark FROM entries"))
def p11(spark, sf):
    df = totals(entries(spark, sf), "group_id", size=F.count(F.lit(1)))
    return _pick(df, mark=F.coalesce(F.when(F.col("flag") != "N", F.col("outcome")), (F.col("size") + 1) / 2.0))


@query("p12_p13_p14_codes", oracle(f"""
SELECT {K}, CASE flag WHEN 'A' THEN 'good' WHEN 'R' THEN 'soft' ELSE 'Unknown' END AS going,
 CASE WHEN qty BETWEEN 10 AND 22 THEN 'turf' WHEN qty BETWEEN 23 AND 29 THEN 'dirt' WHEN qty >= 51 THEN 'jump' ELSE 'Unknown' END AS track,
 CASE WHEN qty BETWEEN 10 AND 22 THEN disc ELSE tax END AS state FROM entries"""))
def p12(spark, sf):
    q = F.col("qty")
    track = F.when(q.between(10, 22), "turf").when(q.between(23, 29), "dirt").when(q >= 51, "jump").otherwise("Unknown")
    return _pick(entries(spark, sf), going=S.lookup("flag", {"A": "good", "R": "soft"}, "Unknown"), track=track, state=F.when(q.between(10, 22), F.col("disc")).otherwise(F.col("tax")))


@query("p15_p16_packed_numbers", oracle(f"""
SELECT {K}, CAST(substr(t, 1, 1) AS INTEGER) * 60 + CAST(substr(t, 2, 2) AS INTEGER) + CAST(substr(t, 4, 1) AS INTEGER) / 10.0 AS seconds,
 CASE WHEN flag = 'A' THEN -disc ELSE disc END AS diff FROM (SELECT *, lpad(CAST(cents % 10000 AS VARCHAR), 4, '0') AS t FROM entries)"""))
def p15(spark, sf):
    sign = F.when(F.col("flag") == "A", "-").otherwise("+")
    return _pick(entries(spark, sf), seconds=S.clock_seconds((F.col("cents") % 10000).cast("string")), diff=S.signed(sign, F.col("disc").cast("string")))


@query("p17_p18_p19_ordinals", oracle(f"""
SELECT {K}, s AS corners, TRY_CAST(split_part(s, '-', 1) AS DOUBLE) AS first, TRY_CAST(nullif(regexp_extract(flag || s, '(\\d+)', 1), '') AS INTEGER) AS digits FROM (
 SELECT *, concat_ws('-', nullif(disc, 0), nullif(tax, 0), nullif(qty % 4, 0)) AS s FROM entries)"""))
def p17(spark, sf):
    df = entries(spark, sf).withColumn("s", S.join_ordinals("disc", "tax", F.col("qty") % 4))
    return _pick(df, corners=F.col("s"), first=S.first_ordinal("s"), digits=S.leading_digits(F.concat("flag", "s")))


@query("p20_key_build_and_decode", oracle(f"""
SELECT {K}, strftime(day, '%Y%m%d') || lpad(CAST(person_b % 100 AS VARCHAR), 2, '0') AS code, CAST(year(day) AS INTEGER) AS yyyy, CAST(person_b % 100 AS INTEGER) AS venue FROM entries"""))
def p20(spark, sf):
    code = F.concat(F.date_format("day", "yyyyMMdd"), F.lpad((F.col("person_b") % 100).cast("string"), 2, "0"))
    df = entries(spark, sf).withColumn("code", code)
    return _pick(df, code=F.col("code"), yyyy=F.substring("code", 1, 4).cast("int"), venue=F.substring("code", 9, 2).cast("int"))


@query("p21_keep_first", oracle(f"SELECT {K}, cents FROM (SELECT *, row_number() OVER (PARTITION BY group_id, line ORDER BY cents, entity, person_a) AS r FROM entries) WHERE r = 1"))
def p21(spark, sf):
    df = entries(spark, sf).select(*KEY, "cents")
    return clean.keep_first(df, ["group_id", "line"], [F.col("cents"), F.col("entity"), F.col("person_a")])


@query("p22_p23_p24_ratios", oracle(f"SELECT {K}, round(qty / nullif(disc, 0), 6) AS ratio, cents / 10.0 AS scaled, CASE WHEN price >= 1000 THEN price END AS valid_price FROM priced", priced=True))
def p22(spark, sf):
    df = clean.rescale_if_large(with_price(entries(spark, sf)), "cents", 100.0, 10.0)
    return _pick(df, ratio=F.round(S.ratio("qty", "disc"), 6), scaled=F.col("cents"), valid_price=F.when(F.col("price") >= 1000, F.col("price")))


@query("p25_p26_group_price_checks", oracle(f"""
SELECT group_id, line, entity, person_a, complete FROM (SELECT *, sum(100.0 / price) OVER (PARTITION BY group_id) AS t, CAST(bool_and(disc <> 0) OVER (PARTITION BY group_id) AS INTEGER) AS complete FROM priced) WHERE t BETWEEN 0.05 AND 0.5""", priced=True))
def p25(spark, sf):
    df = totals(with_price(entries(spark, sf)), "group_id", t=F.sum(100.0 / F.col("price")), full=F.bool_and(F.col("disc") != 0))
    return df.filter(F.col("t").between(0.05, 0.5)).select(*KEY, F.col("full").cast("int").alias("complete"))


@query("p27_p29_fixed_bins", oracle(f"""
SELECT {K}, CASE WHEN m > 0 AND m <= 1400 THEN 'sprint' WHEN m > 1400 AND m <= 1800 THEN 'mile' WHEN m > 1800 AND m <= 2200 THEN 'intermediate' WHEN m > 2200 AND m <= 9999 THEN 'long' END AS dist,
 CASE WHEN disc >= 0 AND disc < 3 THEN 'low' WHEN disc >= 3 AND disc < 8 THEN 'mid' WHEN disc >= 8 AND disc < 99 THEN 'high' END AS band, (m // 200) * 200 AS step FROM (SELECT *, CAST(qty * 100 - 100 AS BIGINT) AS m FROM entries)"""))
def p27(spark, sf):
    df = entries(spark, sf).withColumn("m", F.col("qty") * 100 - 100)
    return _pick(df, dist=S.distance_category("m"), band=S.cut("disc", [0, 3, 8, 99], ["low", "mid", "high"], right=False), step=S.step_bin("m", 200))


@query("p28_quantile_bins", oracle(f"""
SELECT {K}, CASE WHEN x <= e1 THEN 0 WHEN x <= e2 THEN 1 WHEN x <= e3 THEN 2 WHEN x <= e4 THEN 3 ELSE 4 END AS bin FROM (SELECT *, cents AS x FROM entries),
 (SELECT quantile_cont(cents, 0.2) AS e1, quantile_cont(cents, 0.4) AS e2, quantile_cont(cents, 0.6) AS e3, quantile_cont(cents, 0.8) AS e4 FROM entries)"""))
def p28(spark, sf):
    df = entries(spark, sf)
    return _pick(df, bin=quantile_bin("cents", quantile_edges(df, "cents", 5)))


@query("p30_p31_targets", oracle(f"""
SELECT {K}, CASE outcome WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS relevance, CAST(CASE outcome WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 WHEN 3 THEN 0.25 ELSE 0.0 END AS DOUBLE) AS graded,
 CASE WHEN outcome = 1 THEN price ELSE 0 END AS realised FROM priced""", priced=True))
def p30(spark, sf):
    return _pick(with_price(entries(spark, sf)), relevance=S.relevance("outcome"), graded=S.graded_target("outcome"), realised=F.when(F.col("outcome") == 1, F.col("price")).otherwise(0.0))


@query("p32_p33_sample_weights", oracle(f"""
SELECT {K}, round(d / (SELECT avg(exp(-0.001 * greatest(0, date_diff('day', day, DATE '2000-12-31')))) FROM entries), 6) AS decay, CAST(y AS DOUBLE) AS by_year, round(1 + ln(1 + qty), 6) AS price_weight FROM (
 SELECT *, exp(-0.001 * greatest(0, date_diff('day', day, DATE '2000-12-31'))) AS d, CASE 2000 - year(day) WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.5 ELSE 0.3 END AS y FROM entries)"""))
def p32(spark, sf):
    df = entries(spark, sf)
    age = F.greatest(F.lit(0), F.datediff(F.lit("2000-12-31").cast("date"), F.col("day")))
    df = df.withColumn("d", F.exp(F.lit(-0.001) * age))
    mean = df.agg(F.avg("d").alias("m"))  # one row
    return _pick(
        df.join(F.broadcast(mean)), decay=F.round(F.col("d") / F.col("m"), 6),
        by_year=S.lookup(2000 - F.year("day"), {0: 1.0, 1: 0.7, 2: 0.5}, 0.3), price_weight=F.round(1 + F.log1p("qty"), 6),
    )


@query("p35_allowlist", oracle("SELECT group_id, line, qty, qty_is_missing FROM (SELECT *, CAST(qty IS NULL AS INTEGER) AS qty_is_missing FROM entries)"))
def p35(spark, sf):
    df = clean.missing_flags(entries(spark, sf), ["qty"])
    cols = clean.allowed_columns(df.columns, ["group_id", "line", "entity", "person_a", "person_b", "day"], ["^cents", "^disc", "tax", "flag$", "status", "day_no"])
    clean.guard_columns(cols)
    return df.select("group_id", "line", *cols)


@query("p36_conform", oracle(f"SELECT CAST(qty AS DOUBLE) AS qty, CAST(0 AS DOUBLE) AS absent, CAST(coalesce(CASE WHEN flag <> 'A' THEN disc END, 0) AS DOUBLE) AS disc FROM entries"))
def p36(spark, sf):
    df = entries(spark, sf).withColumn("disc", F.when(F.col("flag") != "A", F.col("disc")))
    return clean.conform(df, ["qty", "absent", "disc"])


@query("p37_overwrite_with_asof", oracle(f"SELECT {K}, price AS odds, rank() OVER (PARTITION BY group_id ORDER BY price) AS popularity FROM priced", priced=True))
def p37(spark, sf):
    df = with_price(entries(spark, sf)).withColumn("odds", F.col("price"))
    df = rank(df, "group_id", "popularity", F.col("odds"), "min").select(*KEY, "odds", "popularity")
    clean.guard_columns(df.columns)
    return df


@query("p38_p39_venue_attributes", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sr.r_name AS region, CAST(sn.n_regionkey <> cn.n_regionkey AS INTEGER) AS away FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey JOIN nation sn ON sn.n_nationkey = s_nationkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN region sr ON sr.r_regionkey = sn.n_regionkey""")
def p38(spark, sf):
    t = lambda n: table(spark, sf, n)
    places = F.broadcast(t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_regionkey", "r_name"))
    s = t("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("sr"), F.col("r_name").alias("region"))
    c = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_regionkey").alias("cr"))
    df = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(sized_broadcast(s), "l_suppkey").join(sized_broadcast(c), "o_custkey")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "region", (F.col("sr") != F.col("cr")).cast("int").alias("away"))


@query("p40_class_season_flags", oracle(f"""
SELECT {K}, CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 10 WHEN o_orderpriority LIKE '%HIGH%' THEN 8 WHEN o_orderpriority LIKE '%MEDIUM%' THEN 5 ELSE 0 END AS class_rank,
 CASE WHEN month(day) IN (12, 1, 2) THEN 1 WHEN month(day) IN (3, 4, 5) THEN 2 WHEN month(day) IN (6, 7, 8) THEN 3 ELSE 4 END AS season, CAST(o_orderpriority LIKE '%LOW%' AS INTEGER) AS night FROM entries JOIN orders ON o_orderkey = group_id"""))
def p40(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("group_id"), "o_orderpriority")
    p = F.col("o_orderpriority")
    cls = F.when(p.contains("URGENT"), 10).when(p.contains("HIGH"), 8).when(p.contains("MEDIUM"), 5).otherwise(0)
    return _pick(entries(spark, sf).join(o, "group_id"), class_rank=cls, season=S.season("day"), night=p.contains("LOW").cast("int"))


@query("p41_expanding_year_folds", oracle("""
SELECT y.y AS fold, (SELECT count(*) FROM entries WHERE year(day) < y.y) AS train, (SELECT count(*) FROM entries WHERE year(day) = y.y) AS valid
FROM (SELECT DISTINCT year(day) AS y FROM entries) y WHERE (SELECT count(*) FROM entries WHERE year(day) < y.y) >= 1000 AND (SELECT count(*) FROM entries WHERE year(day) = y.y) >= 100"""))
def p41(spark, sf):
    per = entries(spark, sf).groupBy(F.year("day").alias("fold")).agg(F.count(F.lit(1)).alias("valid"))
    w = Window.partitionBy(F.lit(0)).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)  # one row per year
    out = per.withColumn("train", F.coalesce(F.sum("valid").over(w), F.lit(0)))
    return out.filter("train >= 1000 AND valid >= 100")


@query("p42_disagreement_target", oracle(f"SELECT {K}, rank() OVER (PARTITION BY group_id ORDER BY price) - outcome AS gap FROM priced", priced=True))
def p42(spark, sf):
    df = rank(with_price(entries(spark, sf)), "group_id", "r", F.col("price"), "min")
    return _pick(df, gap=F.col("r") - F.col("outcome"))


@query("p43_first_known", oracle(f"SELECT {K}, coalesce(CASE WHEN disc > 5 THEN disc END, CASE WHEN tax > 4 THEN tax END, qty) AS value FROM entries"))
def p43(spark, sf):
    return _pick(entries(spark, sf), value=F.coalesce(F.when(F.col("disc") > 5, F.col("disc")), F.when(F.col("tax") > 4, F.col("tax")), F.col("qty")))
