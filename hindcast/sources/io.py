"""Reading and writing: columnar scans with pruning, snapshot layout, report sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F


def scan(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, where: str | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """Scan with the predicate and the column list handed to the reader."""
    reader = spark.read.format(fmt).options(**options)
    df = reader.load(path)
    if where:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def jdbc(spark: SparkSession, url: str, table: str, column: str, lower, upper, partitions: int, fetch: int = 10_000, **options) -> DataFrame:
    """Partitioned database scan: one range of ``column`` per task, rows fetched in chunks."""
    return (
        spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", column)
        .option("lowerBound", str(lower)).option("upperBound", str(upper)).option("numPartitions", str(partitions))
        .option("fetchsize", str(fetch)).options(**options).load()
    )


def write_snapshots(df: DataFrame, path: str, year: str = "year", kind: str = "snapshot_type") -> None:
    """One directory per (year, snapshot type); a rerun replaces only the directories it writes."""
    out = df.repartition(F.col(year), F.col(kind), F.pmod(F.xxhash64(*[c for c in df.columns if c not in (year, kind)]), F.lit(32)))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(year, kind).parquet(path)


def read_snapshots(spark: SparkSession, path: str, first: int, last: int, kinds: list[str]) -> DataFrame:
    """Year range and snapshot types as partition predicates; years that do not exist are simply absent."""
    df = spark.read.parquet(path)
    return df.filter(F.col("year").between(first, last) & F.col("snapshot_type").isin(kinds))


def read_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union of part files by column name; a column missing in some parts is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p) for p in paths])


def write_report(df: DataFrame, path: str, fmt: str = "parquet", order: list | None = None, partition_by: list[str] | None = None) -> None:
    """Parquet, CSV or JSON sink; a total order is a property of the sink only."""
    if order:
        df = df.orderBy(*order)
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Idempotent replacement of the key partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def flatten_json(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """JSON documents of unknown and differing shape as one row per leaf: ``path`` ("metrics.roi", "folds[0].stake"),
    ``number`` (NULL where it is none) and ``text``.

    Documents are read as variants, so no schema is inferred or agreed on; one pass per level of nesting.  Text that is no
    JSON is one leaf with an empty path and no value, a JSON null a leaf without a value; an empty object or array has none.
    """
    level = docs.select(*keys, F.lit("").alias("path"), F.try_parse_json(text).alias("v"))
    leaves = []
    while True:
        kind = F.coalesce(F.schema_of_variant("v"), F.lit("VOID"))
        inner = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        leaves.append(level.filter(~inner))
        nested = level.filter(inner)
        if nested.isEmpty():
            break
        parts = nested.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("v").outer()))
        dot = F.when(F.col("path") == "", "").otherwise(".")
        name = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), "pos", F.lit("]"))).otherwise(F.concat("path", dot, "key"))
        level = parts.select(*keys, name.alias("path"), F.col("value").alias("v"))
    out = reduce(lambda a, b: a.unionByName(b), leaves)
    return out.select(*keys, "path", F.try_variant_get("v", "$", "double").alias("number"), F.try_variant_get("v", "$", "string").alias("text"))


def read_metrics(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The leaves of all metric files below ``path``, one document a file, one folder ``name``=... an experiment."""
    files = spark.read.text(path, wholetext=True)
    return flatten_json(files, [name], "value")
