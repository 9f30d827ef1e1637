"""As-of joins, snapshots, semi/anti joins and fallback look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, decide
from ..operators.calendar import trailing_days
from ..operators.history import history, past
from ..operators.relative import rank, totals
from ..plans.hot import sized_broadcast
from ..functions import scalars as S
from ..plans.registry import query
from ..sources.tables import entries, oracle, table, with_price
from .groupwise import CAND, RUN, candidates
from .histories import ENTITY, K, KEY, win, _pick


@query("j01_equi_and_dimension_join", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, p_brand, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey""")
def j01(spark, sf):
    t = lambda n: table(spark, sf, n)
    s = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    df = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    df = df.join(sized_broadcast(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")), "l_partkey", "left")
    df = df.join(sized_broadcast(s), "l_suppkey", "left")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_custkey", "p_brand", "n_name")


@query("j02_asof_with_tolerance", """
WITH tr AS (SELECT event_id, user_id, CAST(ts AS DATE) AS tday, value, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS pref FROM events WHERE event_type IN ('view', 'click')),
tr1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, tday ORDER BY pref DESC, event_id DESC) AS r FROM tr) WHERE r = 1)
SELECT p.event_id, CASE WHEN date_diff('day', tday, CAST(p.ts AS DATE)) <= 10 THEN tday END AS tday, CASE WHEN date_diff('day', tday, CAST(p.ts AS DATE)) <= 10 THEN t.value END AS tvalue
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN tr1 t ON p.user_id = t.user_id AND CAST(p.ts AS DATE) >= t.tday""", dates=('tday',))
def j02(spark, sf):
    """Latest training row up to the event day, at most ten days old; same-day ties go to the preferred course."""
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "day")
    right = e.filter("event_type IN ('view', 'click')").select(
        "user_id", F.col("day").alias("tday"), F.col("value").alias("tvalue"), F.col("event_id").alias("eid"),
        F.when(F.col("event_type") == "view", 1).otherwise(0).alias("pref"),
    )
    out = asof.asof_join(left, right, "user_id", "day", "tday", ["tvalue"], tolerance=10, prefer=[F.col("pref"), F.col("eid")])
    return out.select("event_id", "tday", "tvalue")


STARTS = "starts AS (SELECT user_id, CAST(ts AS DATE) AS race_day, min(ts) AS start FROM events WHERE event_type = 'purchase' GROUP BY ALL)"


def _starts(spark, sf):
    e = table(spark, sf, "events").withColumn("race_day", F.to_date("ts"))
    return e, e.filter("event_type = 'purchase'").groupBy("user_id", "race_day").agg(F.min("ts").alias("start"))


def _ticks(spark, sf):
    e, s = _starts(spark, sf)
    g = s.select(F.concat_ws("|", "user_id", "race_day").alias("gid"), "start")
    t = e.select(F.concat_ws("|", "user_id", "race_day").alias("gid"), "ts", "value", "event_id", "event_type")
    return t, g


def _snap_sql(minutes, extra=""):
    cols = ", ".join(
        f"max(ts) FILTER (ts <= start - INTERVAL {m} MINUTE) AS ts_{n}, arg_max(value, ts) FILTER (ts <= start - INTERVAL {m} MINUTE) AS value_{n}"
        for n, m in minutes.items()
    )
    return f"""WITH {STARTS} SELECT s.user_id || '|' || s.race_day AS gid, start, {cols}{extra} FROM events e JOIN starts s
     ON e.user_id = s.user_id AND CAST(e.ts AS DATE) = s.race_day GROUP BY 1, 2"""


@query("j03_snapshot_asof", _snap_sql({"t10": 10}))
def j03(spark, sf):
    t, g = _ticks(spark, sf)
    return asof.snapshots(t, g, "gid", "ts", "start", ["value"], {"t10": 10}, tie=["event_id"])


OFFSETS = {"t60": 60, "t30": 30, "t10": 10, "t5": 5, "final": 0}


@query("j04_j27_multi_offset", _snap_sql(OFFSETS))
def j04(spark, sf):
    t, g = _ticks(spark, sf)
    return asof.snapshots(t, g, "gid", "ts", "start", ["value"], OFFSETS, tie=["event_id"])


@query("j05_snapshot_coverage", f"""SELECT count(*) AS groups, count(ts_t10) AS covered, round(avg((epoch_us(start) // 1000000 - epoch_us(ts_t10) // 1000000) / 60.0), 4) AS minutes FROM ({_snap_sql({'t10': 10})})""")
def j05(spark, sf):
    t, g = _ticks(spark, sf)
    df = asof.snapshots(t, g, "gid", "ts", "start", ["value"], {"t10": 10}, tie=["event_id"])
    return df.agg(F.count(F.lit(1)).alias("groups"), F.count("ts_t10").alias("covered"), F.round(F.avg(asof.minutes_before("start", "ts_t10")), 4).alias("minutes"))


@query("j06_j08_latest_per_key", "SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def j06(spark, sf):
    return asof.latest(table(spark, sf, "events"), "user_id", [F.col("ts"), F.col("event_id")], ["event_id", "ts", "value"])


@query("j07_lateral_latest", f"""WITH {STARTS} SELECT s.user_id, s.race_day, l.event_id FROM starts s LEFT JOIN LATERAL (
 SELECT event_id FROM events e WHERE e.user_id = s.user_id AND CAST(e.ts AS DATE) = s.race_day AND e.ts < s.start ORDER BY ts DESC, event_id DESC LIMIT 1) l ON TRUE""", dates=('race_day',))
def j07(spark, sf):
    """LATERAL ... ORDER BY ts DESC LIMIT 1 as one aggregation instead of a probe per row."""
    e, s = _starts(spark, sf)
    j = s.join(e.select("user_id", "race_day", "ts", "event_id"), ["user_id", "race_day"], "left")
    ok = F.col("ts") < F.col("start")
    return j.groupBy("user_id", "race_day").agg(F.max_by(F.when(ok, F.col("event_id")), F.when(ok, F.struct("ts", "event_id"))).alias("event_id"))


@query("j10_padded_key_dimension", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j10(spark, sf):
    pad = lambda c: S.pad(F.trim(F.col(c).cast("string")), 5).alias("k")
    n = table(spark, sf, "nation").select(pad("n_nationkey"), "n_name")
    return table(spark, sf, "customer").select("c_custkey", pad("c_nationkey")).join(F.broadcast(n), "k", "left").select("c_custkey", "n_name")


@query("j12_j13_semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def j12(spark, sf):
    c = table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("j14_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j14(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


FULL = """SELECT coalesce(a.user_id, b.user_id) AS user_id, round(a.m - b.m, 6) AS diff, CASE WHEN a.user_id IS NULL THEN 'b' WHEN b.user_id IS NULL THEN 'a' ELSE 'both' END AS side
FROM (SELECT user_id, avg(value) AS m FROM events WHERE event_type = 'click' AND user_id % 7 <> 0 GROUP BY 1) a
FULL JOIN (SELECT user_id, avg(value) AS m FROM events WHERE event_type = 'view' AND user_id % 5 <> 0 GROUP BY 1) b ON a.user_id = b.user_id"""


@query("j15_full_outer_compare", FULL)
def j15(spark, sf):
    e = table(spark, sf, "events")
    a = e.filter("event_type = 'click' AND user_id % 7 <> 0").groupBy("user_id").agg(F.avg("value").alias("ma"))
    b = e.filter("event_type = 'view' AND user_id % 5 <> 0").groupBy("user_id").agg(F.avg("value").alias("mb"))
    side = F.when(F.col("ma").isNull(), "b").when(F.col("mb").isNull(), "a").otherwise("both")
    return a.join(b, "user_id", "full").select("user_id", F.round(F.col("ma") - F.col("mb"), 6).alias("diff"), side.alias("side"))


P_EXACT = "(PARTITION BY person_a, flag ORDER BY day_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
P_BROAD = "(PARTITION BY person_a ORDER BY day_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("j21_j22_fallback_chain", oracle(f"""
SELECT {K}, round(CASE WHEN n1 >= 30 THEN s1 / n1 WHEN n2 >= 50 THEN s2 / n2 WHEN n3 >= 20 THEN s3 / n3 ELSE 3.0 END, 6) AS level FROM (
 SELECT {K}, count(*) OVER a AS n1, sum(outcome) OVER a AS s1, count(*) OVER b AS n2, sum(outcome) OVER b AS s2, count(*) OVER c AS n3, sum(outcome) OVER c AS s3 FROM entries
 WINDOW a AS {P_EXACT}, b AS {P_BROAD}, c AS {P_BROAD.replace('person_a', 'flag')})"""))
def j21(spark, sf):
    """Point-in-time fallback: exact condition, then person, then condition, then a constant."""
    df = entries(spark, sf)
    for keys, t in ((["person_a", "flag"], "1"), (["person_a"], "2"), (["flag"], "3")):
        df = trailing_days(df, keys, "day", {f"n{t}": F.lit(1), f"s{t}": F.col("outcome")}, [None])
    level = lambda t, least: (F.col(f"n{t}_all") >= least, F.try_divide(f"s{t}_all", f"n{t}_all"))
    return _pick(df, level=F.round(asof.fallback(df, [level("1", 30), level("2", 50), level("3", 20)], F.lit(3.0)), 6))


@query("j23_real_else_synthetic", oracle(f"""
SELECT {K}, CASE WHEN bool_or(real IS NOT NULL) OVER (PARTITION BY group_id) THEN real ELSE round(0.8 / p_market, 4) END AS price FROM (
 SELECT *, CASE WHEN group_id % 3 = 0 THEN price END AS real FROM priced)""", priced=True))
def j23(spark, sf):
    df = with_price(entries(spark, sf)).withColumn("real", F.when(F.col("group_id") % 3 == 0, F.col("price"))).withColumn("kind", F.lit("win"))
    df = totals(df, "group_id", have=F.count("real"))
    price = F.when(F.col("have") > 0, F.col("real")).otherwise(F.round(decide.synthetic_price("p_market", "kind"), 4))
    return _pick(df, price=price)


SNAP = "snap AS (SELECT group_id, 'win' AS ticket_type, CAST(k AS VARCHAR) AS combination, CAST(o * 1.5 AS DOUBLE) AS odds FROM runners WHERE o <= 4)"


def snapshot_prices(spark, sf):
    from .groupwise import runners

    return runners(spark, sf).filter("o <= 4").select("group_id", F.lit("win").alias("ticket_type"), F.col("k").cast("string").alias("combination"), (F.col("o") * F.lit(1.5)).alias("odds"))


@query("j24_d10_candidate_price_join", oracle("SELECT c.group_id, c.ticket_type, c.combination, odds, round(p * odds, 6) AS ev FROM cand c LEFT JOIN snap USING (group_id, ticket_type, combination) WHERE p >= 1e-4", RUN, CAND, SNAP, priced=True))
def j24(spark, sf):
    keys = ["group_id", "ticket_type", "combination"]
    df = candidates(spark, sf).join(snapshot_prices(spark, sf), keys, "left")
    return df.select(*keys, "odds", F.round(decide.expected_value("p", "odds"), 6).alias("ev"))


@query("j25_intersection_population", oracle(f"SELECT {K} FROM (SELECT *, CASE WHEN disc <> 3 THEN qty END AS a, CASE WHEN tax <> 2 THEN qty END AS b FROM entries) WHERE a IS NOT NULL AND b IS NOT NULL"))
def j25(spark, sf):
    df = entries(spark, sf).withColumn("a", F.when(F.col("disc") != 3, F.col("qty"))).withColumn("b", F.when(F.col("tax") != 2, F.col("qty")))
    return df.dropna(subset=["a", "b"]).select(*KEY)


@query("j26_typed_result_join", "SELECT l.doc_id, l.quality, d.lang FROM labels l LEFT JOIN documents d ON CAST(l.doc_id AS VARCHAR) = CAST(d.doc_id AS VARCHAR)")
def j26(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").cast("long").alias("doc_id"), "lang")
    return table(spark, sf, "labels").select("doc_id", "quality").join(d, "doc_id", "left")
