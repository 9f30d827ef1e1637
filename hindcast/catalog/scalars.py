"""Scalar functions on derived text and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.registry import query
from ..sources.tables import entries, oracle, table
from .histories import K, KEY, _pick

PACK = """packs AS (SELECT *, lpad(CAST(line AS VARCHAR), 2, '0') || lpad(CAST(qty * 7 AS VARCHAR), 4, '0') || lpad(CAST(disc AS VARCHAR), 2, '0')
 || '00' || '0123' || '01' || lpad(CAST(person_a % 90 + 1 AS VARCHAR), 2, '0') || CASE WHEN flag = 'A' THEN '0000' WHEN flag = 'N' THEN '9999' ELSE '0150' END || '03' AS packed FROM entries)"""


def _packs(spark, sf):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return entries(spark, sf).withColumn("packed", F.concat(
        two(F.col("line")), F.lpad((F.col("qty") * 7).cast("string"), 4, "0"), two(F.col("disc")), F.lit("00012301"),
        two(F.col("person_a") % 90 + 1), F.when(F.col("flag") == "A", "0000").when(F.col("flag") == "N", "9999").otherwise("0150"), F.lit("03"),
    ))


@query("f01_x04_packed_records", oracle(f"""
SELECT {K}, key, CASE WHEN regexp_full_match(t, '0*|9+') THEN NULL ELSE CAST(t AS INTEGER) / 10.0 END AS price, CAST(r AS INTEGER) AS pop_rank FROM (
 SELECT {K}, substr(packed, i * 8 + 1, 2) AS key, substr(packed, i * 8 + 3, 4) AS t, substr(packed, i * 8 + 7, 2) AS r FROM packs, range(0, 3) g(i)) WHERE key <> '00'""", PACK))
def f01(spark, sf):
    df = _packs(spark, sf).select(*KEY, F.explode(S.unpack("packed", "win")).alias("r"))
    return df.select(*KEY, "r.key", "r.price", "r.pop_rank")


@query("f02_combinations", oracle(f"""
SELECT {K}, least(a, b) || '-' || greatest(a, b) AS unordered, a || '-' || b AS ordered, lpad(CAST(least(a, b) AS VARCHAR), 2, '0') || lpad(CAST(greatest(a, b) AS VARCHAR), 2, '0') AS padded, least(a, b) AS decoded
FROM (SELECT *, line AS a, CAST(person_a % 18 + 1 AS INTEGER) AS b FROM entries)"""))
def f02(spark, sf):
    sel = F.array(F.col("line"), (F.col("person_a") % 18 + 1).cast("int"))
    padded = S.combination(sel, ordered=False, width=2)
    return _pick(entries(spark, sf), unordered=S.combination(sel, False), ordered=S.combination(sel, True), padded=padded, decoded=S.selection(padded, 2)[0])


@query("f03_strings", "SELECT p_partkey, lpad(trim(p_brand), 10, '*') AS padded, replace(p_name, ' ', '_') AS snake, split_part(p_name, ' ', 2) AS noun, CAST(contains(p_name, 'ring') AS INTEGER) AS ring, substr(p_type, 2, 3) AS mid FROM part")
def f03(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.lpad(F.trim("p_brand"), 10, "*").alias("padded"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("snake"),
        F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)).alias("noun"), F.col("p_name").contains("ring").cast("int").alias("ring"), F.substring("p_type", 2, 3).alias("mid"),
    )


@query("f04_f05_tick_times", """
SELECT event_id, date_trunc('minute', ts) AS tick, (epoch_us(date_trunc('day', ts) + INTERVAL 15 HOUR + INTERVAL 25 MINUTE) - epoch_us(date_trunc('minute', ts))) / 60000000.0 AS minutes, date_trunc('day', ts) + INTERVAL 15 HOUR + INTERVAL 25 MINUTE AS start FROM events""")
def f04(spark, sf):
    """Year-less 'MMDDHHMM' text back to a time near the start, and minutes to the start."""
    e = table(spark, sf, "events").withColumn("txt", F.date_format("ts", "MMddHHmm"))
    e = e.withColumn("start", S.at_clock(F.to_date("ts"), F.lit("1525")))
    e = e.withColumn("tick", S.tick_time_near("start", "txt"))
    minutes = (F.unix_timestamp("start") - F.unix_timestamp("tick")) / 60.0
    naive = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return e.select("event_id", naive("tick"), minutes.alias("minutes"), naive("start"))


@query("f06_f07_ages_and_periods", oracle(f"SELECT {K}, round(date_diff('day', DATE '1990-03-15', day) / 365.25, 6) AS age, year(day) AS y, month(day) AS m, CAST(date_trunc('month', day) AS DATE) AS bucket FROM entries"), dates=('bucket',))
def f06(spark, sf):
    return _pick(entries(spark, sf), age=F.round(S.age_years(F.lit("1990-03-15").cast("date"), "day"), 6), y=F.year("day"), m=F.month("day"), bucket=F.trunc("day", "month"))


@query("f08_math", oracle(f"""
SELECT {K}, round(ln(qty), 6) AS lg, round(ln(1 + disc), 6) AS lg1, round(sqrt(cents), 6) AS root, greatest(2, least(7, disc)) AS clipped, round(ln(p / (1 - p)), 6) AS logit, round(1 / (1 + exp(-(qty - 25) / 10.0)), 6) AS sig
FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, disc / 10.0)) AS p FROM entries)"""))
def f08(spark, sf):
    return _pick(entries(spark, sf), lg=F.round(F.log("qty"), 6), lg1=F.round(F.log1p("disc"), 6), root=F.round(F.sqrt("cents"), 6), clipped=S.clip("disc", 2, 7),
                 logit=F.round(S.logit(F.col("disc") / 10.0), 6), sig=F.round(S.sigmoid((F.col("qty") - 25) / 10.0), 6))


@query("f09_f10_row_deviation", oracle(f"""
SELECT {K}, round(sqrt((a * a + b * b + c * c - (a + b + c) * (a + b + c) / 3.0) / 2), 5) AS sd, round(sqrt((a * a + b * b + c * c) / 3.0 - power((a + b + c) / 3.0, 2)), 5) AS packed_sd FROM (SELECT *, disc AS a, tax AS b, qty % 7 AS c FROM entries)"""))
def f09(spark, sf):
    packed = F.concat_ws("-", "disc", "tax", F.col("qty") % 7)
    return _pick(entries(spark, sf), sd=F.round(S.row_std("disc", "tax", F.col("qty") % 7), 5), packed_sd=F.round(S.split_std(packed), 5))


@query("f11_f13_safe_arithmetic", oracle(f"SELECT {K}, round(coalesce(qty / nullif(disc, 0), 0), 6) AS q, (cents // 100) * 100 AS floored FROM entries"))
def f11(spark, sf):
    return _pick(entries(spark, sf), q=F.round(S.ratio("qty", "disc", 0.0), 6), floored=S.unit_floor("cents"))


@query("f12_parameter_hash", "SELECT p_partkey, sha256(p_brand || '|' || p_type || '|' || CAST(p_size AS VARCHAR)) AS name FROM part")
def f12(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.sha2(F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")), 256).alias("name"))
