"""Readers for the star-schema and event tables, and the views built on them.

Domain roles: an order is a *group* whose lines compete, the part is the
*entity*, supplier and customer are *persons*, the order date is the event day,
the rank of the line's price inside the order is the *outcome*.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.calendar import day_number
from ..plans.hot import deal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line: who ran in which group, when, and how it ended."""
    li = deal(table(spark, sf_dir, "lineitem"), "l_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    df = li.join(o, li.l_orderkey == o.o_orderkey)
    day = F.col("o_orderdate").cast("date")
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_extendedprice").desc())
    return df.select(
        F.col("l_orderkey").alias("group_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("entity"),
        F.col("l_suppkey").alias("person_a"),
        F.col("o_custkey").alias("person_b"),
        day.alias("day"),
        day_number(day).alias("day_no"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.col("l_quantity").cast("int").alias("qty"),
        F.round(F.col("l_discount") * 100).cast("int").alias("disc"),
        F.round(F.col("l_tax") * 100).cast("int").alias("tax"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.rank().over(w).cast("int").alias("outcome"),
    )


#: The same view as SQL, used as a common prefix of oracle queries.
ENTRIES_SQL = """
entries AS (
  SELECT l_orderkey AS group_id, l_linenumber AS line, l_partkey AS entity, l_suppkey AS person_a,
         o_custkey AS person_b, CAST(o_orderdate AS DATE) AS day,
         CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day_no,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS INTEGER) AS qty,
         CAST(round(l_discount * 100) AS INTEGER) AS disc, CAST(round(l_tax * 100) AS INTEGER) AS tax,
         l_returnflag AS flag, l_linestatus AS status,
         CAST(rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS INTEGER) AS outcome
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def with_price(df: DataFrame) -> DataFrame:
    """Adds the unit price, the group overround and the market probability."""
    from ..operators.relative import implied

    return implied(df.withColumn("price", F.col("cents") / F.col("qty") / 100.0), "group_id", "price")


PRICED_SQL = ENTRIES_SQL + """,
priced0 AS (SELECT *, cents / qty / 100.0 AS price FROM entries),
priced AS (SELECT *, sum(1.0 / price) OVER (PARTITION BY group_id) AS overround,
                  (1.0 / price) / sum(1.0 / price) OVER (PARTITION BY group_id) AS p_market FROM priced0)
"""


def oracle(body: str, *ctes: str, priced: bool = False) -> str:
    """Oracle text: the entries view, optional further CTEs, then the query."""
    return "WITH " + ",\n".join([PRICED_SQL if priced else ENTRIES_SQL, *ctes]) + "\n" + body
