"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source has a target number of words (its share of the mix, at most ``limit`` times its own words; what is above
is shared again by weight).  target / size = whole copies and a rest r in [0, 1).  All documents get the whole copies;
for the rest each document has an inclusion probability p around r, unequal by length, with sum(p * words) = r * words
of the source.  With u uniform by document, documents are ranked by the odds ratio (u / (1 - u)) / (p / (1 - p)), and
the first ones are taken until the rest's words are reached: a sample of fixed size in words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import WORD, running_total, stored, uniform

#: Buckets of the ranking variable per source while its words are added up.
RANK_BUCKETS = 4096


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """Per source: words, Pareto statistics and target.  One row per source from here on.

    Sources by code point (null last) get the weights in turn.  With the sources in the order of limit * words / weight,
    a prefix of them stands at its limit and the others share what is left by weight.
    """
    big = F.col("size").cast("decimal(20,0)")
    per = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(big * big).cast("double").alias("squares"), F.max("size").alias("longest"),
    )
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight)
    per = per.withColumn("most", F.lit(float(limit)) * F.col("source_size")).withColumn("at", F.col("most") / F.col("weight"))
    by = Window.orderBy("at", F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    rest = F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = rest / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    # the water level is the one of the first source that does not reach its limit
    per = per.withColumn("level", F.min(F.when(F.col("at") > F.col("level"), F.struct("at", "source", "level"))).over(Window.partitionBy())["level"])
    target = F.coalesce(F.least(F.col("most"), F.col("level") * F.col("weight")), F.col("most"))
    return per.select("source", "source_size", "squares", "longest", target.alias("target"))


def _ranked(sizes: DataFrame, per: DataFrame, tilt: float, seed: str) -> DataFrame:
    """``sizes`` (doc_id, source, size and others) with __whole copies, the __rest and the __rank in their source."""
    rows = sizes.join(per.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    ratio = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    rows = rows.withColumn("__whole", F.floor(ratio).cast("long"))
    rows = rows.withColumn("__rest", ratio - F.col("__whole"))
    middle = F.coalesce(F.col("squares") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))  # sum(size * (size - middle)) = 0
    reach = F.greatest(F.col("longest") - middle, middle, F.lit(1.0))
    p = F.col("__rest") + F.lit(float(tilt)) * F.least(F.col("__rest"), 1 - F.col("__rest")) * (F.col("size") - middle) / reach
    u = uniform(seed, F.col("doc_id"))
    return rows.withColumn("__rank", (u / (1 - u)) * (1 - p) / F.greatest(p, F.lit(1e-300)))


def _words(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _chosen(docs: DataFrame, weights, share, limit, tilt, seed, key, text, source, name) -> tuple[DataFrame, DataFrame]:
    sizes = stored(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), _words(text).alias("size")), f"{name}-sizes")
    per = stored(targets(sizes, weights, share, limit), f"{name}-targets")  # stored, so that Spark knows its size when it chooses the join
    rows = _ranked(sizes, per, tilt, seed)
    bucket = F.floor(F.lit(float(RANK_BUCKETS)) * (F.col("__rank") / (1 + F.col("__rank")))).cast("int")
    rows = rows.withColumns({"__name": F.coalesce("source", F.lit("")), "__null": F.col("source").isNull()})
    rows = running_total(rows, ["__name", "__null"], bucket, [F.col("__rank"), F.col("doc_id"), F.col("size")], F.col("size"), "__sum")
    # a document is in when its middle is: the last one only where that comes nearer to the target
    chosen = (2 * F.col("__sum") - F.col("size") <= 2 * F.col("__rest") * F.col("source_size")) & (F.col("__rest") > 0)
    return rows.withColumn("__chosen", chosen), per


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, limit: float = 2.0, tilt: float = 0.5,
    seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source", name: str = "mix",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size (words), source_size, target, copies, taken = copies * size.

    ``tilt`` in [0, 1): how much more likely long documents are taken than short ones.
    Null or empty text: size 0, taken 0.  Null source: a source like any other, the last by name.  Null key: a key
    like any other.  Repeated rows are documents of their own with the same u.  Ties go by key, then size.  Empty table:
    no rows.  Other columns are ignored.  The same rows give the same result however they are partitioned.
    """
    rows, _ = _chosen(docs, weights, share, limit, tilt, seed, key, text, source, name)
    copies = F.col("__whole") + F.col("__chosen").cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_documents(
    docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, limit: float = 2.0, tilt: float = 0.5,
    seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source", name: str = "mix",
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix`` takes it.  Rows without a word are not in it.

    Only the last chosen rank of each source is looked up, so texts stay where they are.  Of rows alike in key and size
    all or none get the chosen copy.
    """
    rows, per = _chosen(docs, weights, share, limit, tilt, seed, key, text, source, name)
    cut = rows.filter("__chosen").groupBy("source").agg(F.max(F.struct("__rank", F.col("doc_id").isNotNull().alias("known"), "doc_id", "size")).alias("__cut"))
    per = stored(per.join(cut.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s"), f"{name}-cuts")
    columns = docs.columns
    whole = docs.select(F.struct(*columns).alias("__row"), F.col(key).alias("doc_id"), F.col(source).alias("source"), _words(text).alias("size"))
    whole = _ranked(whole, per, tilt, seed)
    own = F.struct("__rank", F.col("doc_id").isNotNull().alias("known"), "doc_id", "size")
    copies = F.col("__whole") + F.coalesce((own <= F.col("__cut")) & (F.col("__rest") > 0), F.lit(False)).cast("long")
    copies = F.when(F.col("size") > 0, copies).otherwise(0).cast("int")
    return whole.filter(copies > 0).select(F.explode(F.array_repeat("__row", copies)).alias("__row")).select("__row.*")
