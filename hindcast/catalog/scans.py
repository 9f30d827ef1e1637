"""Scans, loads, refreshes, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, clean
from ..operators.history import history, last_k, past
from ..plans.registry import query
from ..sources.io import scan
from ..sources.tables import entries, oracle, table
from .histories import ENTITY, K, KEY


@query("s01_filtered_load", oracle(f"""
SELECT {K}, cents, outcome FROM entries WHERE day >= DATE '1997-01-01' AND day < DATE '1999-01-01' AND entity IN (SELECT p_partkey FROM part WHERE p_size <= 10)"""))
def s01(spark, sf):
    part = table(spark, sf, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("entity"))
    df = clean.years(entries(spark, sf), "day", 1997, 1998)
    return df.join(part, "entity", "left_semi").select(*KEY, "cents", "outcome")


@query("s02_context_load", oracle(f"""
SELECT DISTINCT {K} FROM entries e WHERE day = DATE '2001-03-01'
 OR group_id IN (SELECT group_id FROM entries WHERE entity IN (SELECT entity FROM entries WHERE day = DATE '2001-03-01')) AND day < DATE '2001-03-01'
    AND (entity IN (SELECT entity FROM entries WHERE day = DATE '2001-03-01') OR outcome <= 3)
 OR (day >= DATE '2000-12-31' AND day < DATE '2001-03-01' AND person_a IN (SELECT person_a FROM entries WHERE day = DATE '2001-03-01'))"""))
def s02(spark, sf):
    """Target day, plus the earlier groups of its entities (themselves and the first three),
    plus the last 60 days of its persons."""
    df = entries(spark, sf)
    target = df.filter("day = DATE '2001-03-01'")
    ents, people = target.select("entity").distinct(), target.select("person_a").distinct()
    past_rows = df.filter("day < DATE '2001-03-01'")
    own = past_rows.join(ents, "entity", "left_semi")
    rivals = past_rows.filter("outcome <= 3").join(own.select("group_id").distinct(), "group_id", "left_semi")
    recent = past_rows.filter("day >= DATE '2000-12-31'").join(people, "person_a", "left_semi")
    parts = [d.select(*KEY) for d in (target, own, rivals, recent)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


@query("s03_s04_projected_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_quantity > 40")
def s04(spark, sf):
    return scan(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity"], "l_shipdate >= TIMESTAMP '2000-01-01' AND l_quantity > 40")


@query("s05_year_range", oracle("SELECT year(day) AS year, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM entries WHERE year(day) BETWEEN 1996 AND 1998 GROUP BY 1"))
def s05(spark, sf):
    df = clean.years(entries(spark, sf), "day", 1996, 1998)
    return df.groupBy(F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


OLD = "(SELECT o_orderkey, o_orderstatus, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderdate < TIMESTAMP '2000-06-01')"
NEW = "(SELECT o_orderkey, 'X' AS o_orderstatus, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate >= TIMESTAMP '2000-05-01')"


def _old_new(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    old = o.filter("o_orderkey % 3 <> 0 AND day < DATE '2000-06-01'")
    new = o.filter("day >= DATE '2000-05-01'").withColumn("o_orderstatus", F.lit("X"))
    return old, new


@query("s08_replace_keys", f"SELECT * FROM {OLD} o WHERE o_custkey NOT IN (SELECT o_custkey FROM {NEW}) UNION ALL SELECT * FROM {NEW}", dates=('day',))
def s08(spark, sf):
    old, new = _old_new(spark, sf)
    return asof.replace_keys(old, new, ["o_custkey"])


@query("s09_insert_absent", f"SELECT * FROM {OLD} UNION ALL SELECT * FROM {NEW} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {OLD})", dates=('day',))
def s09(spark, sf):
    old, new = _old_new(spark, sf)
    return asof.insert_absent(old, new, ["o_orderkey"])


@query("s10_incremental_refresh", f"""SELECT o_orderkey, o_orderstatus, o_custkey, day FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY v DESC) AS r FROM (
 SELECT *, 0 AS v FROM {OLD} WHERE day < DATE '2000-05-31' UNION ALL SELECT *, 1 FROM {NEW} WHERE day >= DATE '2000-05-31')) WHERE r = 1""", dates=('day',))
def s10(spark, sf):
    old, new = _old_new(spark, sf)
    cut = F.date_sub(F.lit("2000-06-01").cast("date"), 1)
    return asof.merge_refresh(old, new, ["o_orderkey"], "day", cut)


WIDE = """wide AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS w1a, CAST(CAST(l_quantity AS INTEGER) * 10 AS VARCHAR) AS w1b,
 CASE WHEN l_returnflag = 'A' THEN '  ' ELSE lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0') END AS w2a, '250' AS w2b,
 CASE WHEN l_linestatus = 'O' THEN '00' ELSE '0307' END AS u1a, CAST(CAST(l_tax * 100 AS INTEGER) AS VARCHAR) AS u1b FROM lineitem)"""


@query("s11_unpivot_payouts", f"""WITH {WIDE} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, bet_type, sel, CAST(pay AS BIGINT) AS payout FROM (
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'win' AS bet_type, trim(w1a) AS sel, w1b AS pay FROM wide UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'win', trim(w2a), w2b FROM wide
 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'umaren', trim(u1a), u1b FROM wide) WHERE sel <> '' AND NOT regexp_full_match(sel, '0*') AND CAST(pay AS BIGINT) > 0""")
def s11(spark, sf):
    li = table(spark, sf, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    wide = li.select(
        *keys, two(F.col("l_linenumber")).alias("pay_win_1a"), (F.col("l_quantity").cast("int") * 10).cast("string").alias("pay_win_1b"),
        F.when(F.col("l_returnflag") == "A", "  ").otherwise(two(F.col("l_suppkey") % 100)).alias("pay_win_2a"), F.lit("250").alias("pay_win_2b"),
        F.when(F.col("l_linestatus") == "O", "00").otherwise("0307").alias("pay_umaren_1a"),
        F.round(F.col("l_tax") * 100).cast("int").cast("string").alias("pay_umaren_1b"),
    )
    return clean.unpivot_slots(wide, keys, ["win", "umaren"], 10, "pay")


@query("s12_payout_map", f"""WITH {WIDE} SELECT l_orderkey, count(*) AS pairs, CAST(sum(CAST(w1b AS BIGINT)) AS BIGINT) AS paid FROM (
 SELECT l_orderkey, w1a, max(w1b) AS w1b FROM (SELECT l_orderkey, w1a, CAST(w1b AS BIGINT) AS w1b FROM wide) GROUP BY ALL) GROUP BY l_orderkey""")
def s12(spark, sf):
    """Nested-map form at the edge: combination -> payout per group, here read back as totals."""
    li = table(spark, sf, "lineitem")
    rows = li.groupBy("l_orderkey", F.lpad(F.col("l_linenumber").cast("string"), 2, "0").alias("sel")).agg((F.max(F.col("l_quantity").cast("int")) * 10).cast("long").alias("pay"))
    m = rows.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("sel", "pay"))).alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x)
    return m.select("l_orderkey", F.size("m").cast("long").alias("pairs"), total.alias("paid"))


@query("s13_live_master_rows", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal IS NULL")
def s13(spark, sf):
    return table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING' OR c_acctbal IS NULL").select("c_custkey", "c_mktsegment")


@query("s14_s15_u01_union_feeds", "SELECT event_id, ts, value, 'a' AS feed FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, ts, value, 'b' FROM events WHERE event_type = 'view'")
def s15(spark, sf):
    e = table(spark, sf, "events")
    pick = lambda kind, feed: e.filter(F.col("event_type") == kind).select("event_id", "ts", "value", F.lit(feed).alias("feed"))
    return pick("click", "a").unionByName(pick("view", "b"))


@query("s16_event_dates", oracle("""SELECT (SELECT max(day) FROM entries) AS latest, (SELECT max(day) FROM entries WHERE day < DATE '1998-07-01') AS previous,
 (SELECT min(day) FROM entries WHERE day > DATE '1998-07-01') AS next"""), dates=('latest', 'previous', 'next'))
def s16(spark, sf):
    d, x = F.col("o_orderdate").cast("date"), F.lit("1998-07-01").cast("date")
    return table(spark, sf, "orders").agg(
        F.max(d).alias("latest"), F.max(F.when(d < x, d)).alias("previous"), F.min(F.when(d > x, d)).alias("next")
    )


@query("s17_a24_entity_summary", oracle(f"""
SELECT entity, n, round(w / n, 6) AS win_rate, round(t / n, 6) AS top3_rate, last_day, round(l5, 6) AS last5 FROM (
 SELECT entity, count(*) AS n, count(*) FILTER (outcome = 1) AS w, count(*) FILTER (outcome <= 3) AS t, max(day) AS last_day FROM entries GROUP BY entity)
 JOIN (SELECT entity, avg(outcome) AS l5 FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day_no DESC, group_id DESC, line DESC, person_a DESC) AS r FROM entries) WHERE r <= 5 GROUP BY entity) USING (entity)"""), dates=('last_day',))
def s17(spark, sf):
    """Serving summary: totals and the last five results as of the newest row."""
    df = entries(spark, sf)
    prior = history(df, "entity", ENTITY, s=last_k("sum", "outcome", 4, default=0), c=last_k("count", "outcome", 4))
    newest = F.struct("day_no", "group_id", "line", "person_a")
    out = prior.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == 1).alias("w"), F.count_if(F.col("outcome") <= 3).alias("t"),
        F.max("day").alias("last_day"),
        F.max_by((F.col("s") + F.col("outcome")) / (F.col("c") + 1), newest).alias("last5"),
    )
    return out.select("entity", "n", F.round(F.col("w") / F.col("n"), 6).alias("win_rate"), F.round(F.col("t") / F.col("n"), 6).alias("top3_rate"), "last_day", F.round("last5", 6).alias("last5"))


@query("t01_sorted_output", oracle(f"SELECT {K}, day FROM entries ORDER BY day, group_id, line, entity, person_a"), dates=('day',))
def t01(spark, sf):
    return entries(spark, sf).select(*KEY, "day").orderBy("day", "group_id", "line", "entity", "person_a")


@query("t02_top_k_per_group", oracle(f"SELECT {K}, r FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY qty DESC, line, entity, person_a) AS r FROM entries) WHERE r <= 3"))
def t02(spark, sf):
    from ..operators.relative import rank

    df = rank(entries(spark, sf), "group_id", "r", -F.col("qty"), "first", ["line", "entity", "person_a"])
    return df.filter("r <= 3").select(*KEY, "r")


@query("t03_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def t03(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query("t05_group_sample", oracle(f"SELECT {K} FROM entries WHERE group_id IN (SELECT group_id FROM (SELECT DISTINCT group_id FROM entries) ORDER BY md5(group_id || ':7'), group_id LIMIT 50)"))
def t05(spark, sf):
    """Seeded sample of groups for an audit table: the smallest hashes."""
    groups = entries(spark, sf).select("group_id").distinct()
    picked = groups.orderBy(F.md5(F.concat(F.col("group_id").cast("string"), F.lit(":7"))), "group_id").limit(50)
    return entries(spark, sf).join(F.broadcast(picked), "group_id", "left_semi").select(*KEY)


@query("u02_distinct", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def u02(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()


A_KEYS = "(SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45)"
B_KEYS = "(SELECT DISTINCT l_orderkey FROM lineitem WHERE l_discount > 0.08)"


@query("u03_key_difference", f"SELECT l_orderkey, 'only_a' AS side FROM {A_KEYS} WHERE l_orderkey NOT IN (SELECT * FROM {B_KEYS}) UNION ALL SELECT l_orderkey, 'only_b' FROM {B_KEYS} WHERE l_orderkey NOT IN (SELECT * FROM {A_KEYS})")
def u03(spark, sf):
    """Both differences from one grouped pass over the keys."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_quantity") > 45).alias("a"), F.bool_or(F.col("l_discount") > 0.08).alias("b"))
    return li.filter("a <> b").select("l_orderkey", F.when(F.col("a"), "only_a").otherwise("only_b").alias("side"))


@query("u04_key_intersection", f"SELECT * FROM {A_KEYS} INTERSECT SELECT * FROM {B_KEYS}")
def u04(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.filter("l_quantity > 45").select("l_orderkey").intersect(li.filter("l_discount > 0.08").select("l_orderkey"))


@query("s06_snapshot_sink", oracle("SELECT year(day) AS year, flag AS snapshot_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM entries WHERE year(day) BETWEEN 1997 AND 1999 AND flag IN ('A', 'R') GROUP BY ALL"))
def s06(spark, sf):
    """Written one directory per (year, type), read back with partition predicates."""
    from ..sources.io import read_snapshots, write_snapshots
    from ..streaming.ticks import work_path

    path = work_path(spark, "snapshots")
    write_snapshots(entries(spark, sf).select(*KEY, "cents", F.year("day").alias("year"), F.col("flag").alias("snapshot_type")), path)
    df = read_snapshots(spark, path, 1997, 1999, ["A", "R"])
    return df.groupBy("year", "snapshot_type").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query("s07_report_sinks", "SELECT f AS fmt, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders, (VALUES ('parquet'), ('csv'), ('json')) v(f) GROUP BY f")
def s07(spark, sf):
    """The same report through the three sinks and back."""
    from ..sources.io import write_report
    from ..streaming.ticks import work_path

    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    out = None
    for fmt in ("parquet", "csv", "json"):
        path = work_path(spark, f"report-{fmt}")
        write_report(df, path, fmt)
        back = spark.read.schema(df.schema).option("header", True).format(fmt).load(path)
        part = back.agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys")).select(F.lit(fmt).alias("fmt"), "n", "keys")
        out = part if out is None else out.unionByName(part)
    return out
