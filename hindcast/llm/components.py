"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a minimum per node (combined before the shuffle) and a join; a node with many edges is dealt with by Spark's
skew join.  The edges of a component become a star around its smallest node after a few rounds.  Every step is a table of
the shared folder, so a lost executor costs a task and not the loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges``: columns a, b (any comparable type), in any direction, repeated or not.  Returns node, component (the
    smallest node it is linked with) for every node that has an edge to another one.  Null ends and loops are ignored."""
    def towards_smaller(df):
        return df.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = stored(towards_smaller(edges.select("a", "b")), f"{name}-edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(towards_smaller(large), f"{name}-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = stored(towards_smaller(small), f"{name}-small")
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
