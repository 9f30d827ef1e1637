"""As-of joins, deadline snapshots, fallback look-ups and incremental loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.hot import sized_broadcast
from .history import history, past


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by,
    left_time: str,
    right_time: str,
    payload: list[str],
    tolerance: int | None = None,
    prefer: list[Column] = (),
) -> DataFrame:
    """For each left row the latest right row of the same key with time <= left time.

    Both sides are stacked and sorted once per key; the newest right row is
    carried forward.  Right rows with equal time are ordered by ``prefer``, the
    last one winning.  ``tolerance`` (in days for dates, seconds for timestamps)
    turns older matches into NULL.
    """
    by = [by] if isinstance(by, str) else list(by)
    hit = F.struct(F.col(right_time).alias("__t"), *[F.col(c) for c in payload])
    tie = F.struct(*prefer) if prefer else F.struct(F.lit(0).alias("none"))
    r = right.select(*by, F.col(right_time).alias("__when"), F.lit(0).alias("__side"), tie.alias("__tie"), hit.alias("__hit"))
    keep = F.struct(*[F.col(c) for c in left.columns])
    l = left.select(*by, F.col(left_time).alias("__when"), F.lit(1).alias("__side"), keep.alias("__row"))
    both = r.unionByName(l, allowMissingColumns=True)
    both = history(both, by, ["__when", "__side", "__tie"], __last=past("last", "__hit"))
    out = both.filter(F.col("__side") == 1).select("__row.*", "__last")
    when = F.col("__last.__t")
    ok = when.isNotNull()
    if tolerance is not None:
        dtype = right.schema[right_time].dataType.typeName()
        age = F.datediff(F.col(left_time), when) if dtype == "date" else F.unix_timestamp(left_time) - F.unix_timestamp(when)
        ok = ok & (age <= tolerance)
    return out.select(
        *left.columns,
        F.when(ok, when).alias(right_time),
        *[F.when(ok, F.col(f"__last.{c}")).alias(c) for c in payload],
    )


def snapshots(
    ticks: DataFrame,
    groups: DataFrame,
    group: str,
    ts: str,
    start: str,
    values: list[str],
    minutes: dict[str, int],
    tie: list[str] = (),
    within=(),
) -> DataFrame:
    """Latest tick at or before ``start - m`` minutes for every named offset m, in one pass.

    One map-side-combined aggregation: a group with many ticks sends one partial
    row per task.  ``within`` adds further grouping columns of the ticks (e.g. a
    row key).  Later ticks never enter.
    """
    joined = ticks.join(sized_broadcast(groups), group)
    order = F.struct(F.col(ts), *[F.col(c) for c in tie])
    picks = []
    for name, m in minutes.items():
        limit = F.col(start) - F.expr(f"interval {m} minutes")
        body = F.struct(F.col(ts).alias("ts"), *[F.col(v) for v in values])
        ok = F.col(ts) <= limit
        picks.append(F.max_by(F.when(ok, body), F.when(ok, order)).alias(name))
    agg = joined.groupBy(group, start, *within).agg(*picks)
    flat = [F.col(f"{n}.ts").alias(f"ts_{n}") for n in minutes]
    flat += [F.col(f"{n}.{v}").alias(f"{v}_{n}") for n in minutes for v in values]
    return agg.select(group, start, *within, *flat)


def minutes_before(start: str, ts: str) -> Column:
    """Signed minutes from the tick to the start."""
    return (F.unix_timestamp(start) - F.unix_timestamp(ts)) / 60.0


def latest(df: DataFrame, keys, order: list[Column], columns: list[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order`` (map-side combined)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, "__best.*")


def fallback(df: DataFrame, levels: list[tuple[Column, Column]], default: Column) -> Column:
    """First statistic whose own condition holds, else ``default``."""
    out = default
    for ok, value in reversed(levels):
        out = F.when(ok & value.isNotNull(), value).otherwise(out)
    return out


def context_rows(df: DataFrame, keys: list[str], parts: list[DataFrame]) -> DataFrame:
    """Rows of ``df`` whose keys occur in any of ``parts`` (key frames): the parts are
    made distinct and semi-joined, which needs no OR of subqueries."""
    wanted = parts[0].select(*keys)
    for p in parts[1:]:
        wanted = wanted.unionByName(p.select(*keys))
    return df.join(wanted.distinct(), keys, "left_semi")


def merge_refresh(old: DataFrame, new: DataFrame, keys: list[str], day: str, cut) -> DataFrame:
    """Old rows before ``cut`` plus new rows from ``cut`` on, newest version per key kept."""
    kept = old.filter(F.col(day) < cut).withColumn("__v", F.lit(0))
    fresh = new.filter(F.col(day) >= cut).withColumn("__v", F.lit(1))
    cols = [c for c in old.columns if c not in keys]
    return latest(kept.unionByName(fresh), keys, [F.col("__v")], cols).select(*old.columns)


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows of the touched keys removed, new rows added: the idempotent upsert."""
    touched = new.select(*keys).distinct()
    return old.join(touched, keys, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] = ()) -> DataFrame:
    """``old`` plus those ``new`` rows whose key is not there yet; of several new rows of
    one key the first by ``order`` (then by all their columns) is taken."""
    cols = [c for c in new.columns if c not in keys]
    first = F.min_by(F.struct(*cols), F.struct(*order, *cols)).alias("__first")
    fresh = new.groupBy(*keys).agg(first).select(*keys, "__first.*").select(*new.columns)
    return old.unionByName(fresh.join(old.select(*keys), keys, "left_anti"))
