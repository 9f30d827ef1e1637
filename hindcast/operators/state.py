"""A versioned state table: batches read the state as it was before them, then add to it.

The state of a key lies in the bucket of its hash.  A batch writes a new version of the buckets it touches, nothing else,
and then one row for each of them into the log; the log is what makes it visible, so a batch that breaks off before leaves
nothing behind that is read.  Older versions stay, so a batch that comes again finds the state before it and changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.hot import cut_lineage, match

#: How the partial result of a batch joins the state.
MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class StateTable:
    """``measures``: name -> (sum | count | min | max, column).  ``path`` is a folder of a store that all executors share."""

    path: str
    keys: list[str]
    measures: dict[str, tuple[str, Column]]
    buckets: int = 256

    def log(self, spark: SparkSession) -> DataFrame:
        """version, bucket, batch of every visible change."""
        folder = f"{self.path}/log"
        schema = "bucket int, batch string, version int"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        return spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _partial(self, df: DataFrame) -> DataFrame:
        of = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
        return df.groupBy(*self.keys).agg(*[of[kind](c).alias(name) for name, (kind, c) in self.measures.items()])

    def state(self, spark: SparkSession, version: int | None = None) -> DataFrame | None:
        """The keys and measures as of a version (the last one without); None before the first batch."""
        log = self.log(spark)
        if version is not None:
            log = log.filter(F.col("version") <= version)
        held = log.groupBy("bucket").agg(F.max("version").alias("version"))  # at most ``buckets`` rows
        if held.isEmpty():
            return None
        rows = spark.read.parquet(f"{self.path}/data")
        return rows.join(F.broadcast(held), ["version", "bucket"], "left_semi").drop("version")

    def apply(self, batch: DataFrame, name: str) -> DataFrame:
        """The rows of ``batch`` with the measures of their key before it (NULL for new keys); adds the batch to the state.

        ``name`` says which batch this is: one that was added before changes nothing and gets the same answer again.  NULL
        keys are a key.  Batches come one after the other; two at a time would claim the same version."""
        spark = batch.sparkSession
        batch = cut_lineage(batch)
        log = self.log(spark)
        done = log.filter(F.col("batch") == name).agg(F.min("version")).first()[0]
        last = log.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] if done is None else done - 1
        before = self.state(spark, last)
        if done is None:
            self._add(batch, before, name, last + 1)
        if before is None:
            return batch.select("*", *[F.lit(None).cast(t.dataType).alias(t.name) for t in self._partial(batch).schema if t.name in self.measures])
        both = batch.alias("l").join(before.alias("r"), match(self.keys), "left")
        return both.select("l.*", *[F.col(f"r.{m}") for m in self.measures])

    def _add(self, batch: DataFrame, before: DataFrame | None, name: str, version: int) -> None:
        spark = batch.sparkSession
        new = cut_lineage(self._partial(batch).withColumn("bucket", self._bucket()))
        touched = new.select("bucket").distinct()
        if before is not None:
            old = before.join(F.broadcast(touched), "bucket", "left_semi")
            new = new.unionByName(old.select(*new.columns))
        merged = new.groupBy("bucket", *self.keys).agg(*[MERGE[kind](m).alias(m) for m, (kind, _) in self.measures.items()])
        folder = f"{self.path}/data/version={version}"  # what a broken batch left here is written over
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        touched.withColumn("batch", F.lit(name)).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/version={version}")
