"""Histories of few large keys: rows are dealt by stretches of days, and every stretch is told what came before it.

A window by key moves all rows once for each set of keys, to as many tasks as there are keys.  Here the totals per day and
key are taken once; they give the stretches (whole days, about ``SLICE_ROWS`` rows each), what each key has before each
stretch, and which rows later stretches have to see again.  Rows move once for all sets of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans import hot
from ..plans.hot import cut_lineage, hot_row_limit, input_bytes, sized_broadcast
from .calendar import FIRST, attach, collapse
from .history import Spec, own_keys

#: Rows of a stretch of days, all keys together or of one key.
SLICE_ROWS = 100_000


def day_cells(df: DataFrame, days: list[str], keys: list[str], measures: dict[str, Column]) -> DataFrame | None:
    """``__rows`` and the sums of ``measures`` per day and distinct ``keys``, as a table; None where windows by key serve
    better: small inputs, and days with more rows than a task may hold."""
    try:
        if input_bytes(df) <= hot.DEAL_FROM:
            return None
    except Exception:  # no JVM plan at hand (Spark Connect)
        return None
    cells = cut_lineage(collapse(df, [*days, *own_keys(df, keys)], {**measures, "__rows": F.lit(1)}))
    longest = cells.groupBy(days[0]).agg(F.sum("__rows").alias("n")).agg(F.max("n")).first()[0]
    return cells if longest and longest <= hot_row_limit(df) else None


def totals_before_group(df: DataFrame, cells: DataFrame, keysets: dict[str, list[str]], group: str, day: str, measures: dict[str, Column]) -> DataFrame:
    """``before_group`` of whole numbers for several sets of keys: adds ``<measure>_<name of the set>``.  ``cells`` holds
    the sums of the same measures per day and all keys."""
    keysets = {tag: own_keys(df, keys) for tag, keys in keysets.items()}
    every = list(dict.fromkeys(k for keys in keysets.values() for k in keys))
    days = cells.groupBy(day).agg(F.sum("__rows").alias("__rows"))
    earlier = F.coalesce(F.sum("__rows").over(Window.partitionBy(F.lit(0)).orderBy(day).rowsBetween(FIRST, -1)), F.lit(0))
    slices = cut_lineage(days.select(day, F.floor(earlier / F.lit(SLICE_ROWS)).cast("int").alias("__slice")))
    number = slices.agg(F.countDistinct("__slice")).first()[0]
    rows = attach(df.select("*", *[c.alias(f"__v{n}") for n, c in measures.items()], F.lit(1).alias("__own"), F.lit(-1).alias("__set")), F.broadcast(slices), [day])
    sums = collapse(attach(cells, F.broadcast(slices), [day]), ["__slice", *every], {f"__v{n}": F.col(n) for n in measures})
    sums = cut_lineage(sums)
    out = rows
    for at, (tag, keys) in enumerate(keysets.items()):  # what each key has before a slice comes as a first row of that slice
        w = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(FIRST, -1)
        carry = collapse(sums, ["__slice", *keys], {f"__v{n}": F.col(f"__v{n}") for n in measures})
        carry = carry.select("__slice", *keys, F.lit(0).alias("__own"), F.lit(at).alias("__set"), *[F.sum(f"__v{n}").over(w).alias(f"__v{n}") for n in measures])
        out = out.unionByName(carry.filter(F.coalesce(*[F.col(f"__v{n}") for n in measures]).isNotNull()), allowMissingColumns=True)
    place = F.dense_rank().over(Window.partitionBy("__slice").orderBy("__own", day, group))
    out = out.repartition(2 * number, "__slice").withColumn("__place", place)
    for at, (tag, keys) in enumerate(keysets.items()):
        w = Window.partitionBy(*keys, "__slice").orderBy("__place").rangeBetween(FIRST, -1)
        values = {n: F.when(F.col("__set").isin(-1, at), F.col(f"__v{n}")) for n in measures}
        out = out.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"{n}_{tag}") for n, v in values.items()])
    return out.filter(F.col("__own") == 1).select(*df.columns, *[f"{n}_{tag}" for tag in keysets for n in measures])


def last_rows(df: DataFrame, cells: DataFrame, keys, order: list[str], k: int, **specs: Spec) -> DataFrame:
    """``history`` with ``last_k`` specs of at most ``k`` rows: sums of whole numbers and counts, 0 without history.
    ``cells`` counts the rows per ``order[0]`` and key.

    Each key has slices of its own; a slice sees the last days before it again, as far back as k rows reach."""
    keys, day = own_keys(df, keys), order[0]
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(FIRST, -1)
    days = collapse(cells, [*keys, day], {"__rows": F.col("__rows")})
    days = days.withColumn("__before", F.coalesce(F.sum("__rows").over(w), F.lit(0)))
    days = days.withColumn("__slice", F.floor(F.col("__before") / F.lit(SLICE_ROWS)).cast("int"))
    days = cut_lineage(days.withColumn("__most", F.max("__slice").over(Window.partitionBy(*keys))).filter("__most > 0").drop("__most"))
    starts = days.groupBy(*keys, "__slice").agg(F.min("__before").alias("__start"))
    meet = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys]
    later = (F.col("r.__slice") >= F.col("l.__slice")) & (F.col("r.__start") < F.col("l.__before") + F.col("l.__rows") + k)
    seen = days.alias("l").join(starts.alias("r"), [*meet, later]).groupBy(*[F.col(f"l.{c}").alias(c) for c in (*keys, day)])
    seen = cut_lineage(seen.agg(F.min("l.__slice").alias("__home"), F.collect_list("r.__slice").alias("__to")))
    out = attach(df, sized_broadcast(seen), [*keys, day]).withColumn("__home", F.coalesce("__home", F.lit(0)))
    out = out.withColumn("__slice", F.explode(F.coalesce("__to", F.array(F.lit(0)))))
    w = Window.partitionBy(*keys, "__slice").orderBy(*order)
    # The sum of the last k rows is what there was before this row, less what there was before the k-th last one.
    upto = {n: {"sum": F.sum, "count": F.count}[s.agg](s.col).over(w.rowsBetween(FIRST, -1)) for n, s in specs.items()}
    out = out.select("*", *[F.coalesce(c, F.lit(0)).alias(f"__u{n}") for n, c in upto.items()])
    out = out.select("*", *[(F.col(f"__u{n}") - F.coalesce(F.lag(f"__u{n}", s.k).over(w), F.lit(0))).alias(n) for n, s in specs.items()])
    return out.filter(F.col("__slice") == F.col("__home")).select(*df.columns, *specs)
