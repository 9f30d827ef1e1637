"""Calendar windows and group-wise histories: sums over earlier days or groups.

Keys that fit a task are handled in place with one exchange.  Keys that do not are
collapsed to one row per (key, day) or (key, group) with map-side partial sums
before anything is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.hot import hot_keys
from .history import history, own_keys

FIRST = Window.unboundedPreceding


def day_number(day) -> Column:
    return F.datediff(F.col(day) if isinstance(day, str) else day, F.lit("1970-01-01").cast("date"))


def collapse(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Partial sums of ``measures`` per distinct ``keys``."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in measures.items()])


def attach(df: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Left join by NULL-safe keys; ``side`` has one row per key."""
    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    extra = [F.col(f"r.{c}") for c in side.columns if c not in keys]
    return df.alias("l").join(side.alias("r"), cond, "left").select("l.*", *extra)


def _whole_numbers(df: DataFrame, measures: dict[str, Column]) -> bool:
    """Integer sums can be subtracted without rounding."""
    fields = df.select(*[c.alias(n) for n, c in measures.items()]).schema.fields
    return all(f.dataType.typeName() in ("byte", "short", "integer", "long") for f in fields)


def trailing_days(df: DataFrame, keys, day: str, measures: dict[str, Column], days: list[int | None]) -> DataFrame:
    """Add ``<measure>_<d>d`` (or ``<measure>_all`` for d=None) for every window length.

    A row exactly d days back is inside; rows of the same day are not.

    Integer measures take one exchange: the sum over d days is the difference of two
    growing sums (up to yesterday, up to d+1 days ago), which costs one step per row
    however dense the window is.  Other measures, and keys too big for a task, are
    collapsed per day first.
    """
    keys = own_keys(df, keys)
    tags = {d: "all" if d is None else f"{d}d" for d in days}
    exact = all(d is None for d in days) or _whole_numbers(df, measures)
    if not exact or hot_keys(df, keys) is not None:
        return _trailing_collapsed(df, keys, day, measures, tags)
    w = Window.partitionBy(*keys).orderBy(day_number(day))
    upto = lambda c, back: F.coalesce(F.sum(c).over(w.rangeBetween(FIRST, -back)), F.lit(0))
    sums = []
    for d, tag in tags.items():
        for n, c in measures.items():
            value = upto(c, 1) if d is None else upto(c, 1) - upto(c, d + 1)
            sums.append(value.alias(f"{n}_{tag}"))
    return df.select("*", *sums)


def _trailing_collapsed(df: DataFrame, keys, day, measures, tags) -> DataFrame:
    daily = collapse(df, [*keys, day], measures)
    w = Window.partitionBy(*keys).orderBy(day_number(day))
    sums = []
    for d, tag in tags.items():
        frame = w.rangeBetween(FIRST if d is None else -d, -1)
        sums += [F.coalesce(F.sum(n).over(frame), F.lit(0)).alias(f"{n}_{tag}") for n in measures]
    return attach(df, daily.select(*keys, day, *sums), [*keys, day])


def global_before(df: DataFrame, day: str, measures: dict[str, Column], cells: DataFrame | None = None) -> DataFrame:
    """Add ``<measure>_before``: totals over all rows of earlier days.

    The ordered part is one row per calendar day and is broadcast back.  With ``cells``, partial sums that have the
    day, the measures are taken from these.
    """
    copies = own_keys(df, [])
    daily = collapse(df if cells is None else cells, [day, *copies], measures)
    w = Window.partitionBy(F.lit(0), *copies).orderBy(day).rowsBetween(FIRST, -1)
    side = daily.select(day, *copies, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"{n}_before") for n in measures])
    return df.join(F.broadcast(side), [day, *copies], "left")


def global_trailing_rows(df: DataFrame, day: str, measures: dict[str, Column], days: int) -> DataFrame:
    """Rolling global totals over the ``days`` calendar days before a row."""
    copies = own_keys(df, [])
    daily = collapse(df, [day, *copies], measures)
    w = Window.partitionBy(F.lit(0), *copies).orderBy(day_number(day)).rangeBetween(-days, -1)
    side = daily.select(day, *copies, *[F.sum(n).over(w).alias(f"{n}_recent") for n in measures])
    return df.join(F.broadcast(side), [day, *copies], "left")


def before_group(df: DataFrame, keys, group: str, day: str, measures: dict[str, Column], grain: str = "group") -> DataFrame:
    """Add ``<measure>_before``: totals of the key over earlier groups (or days).

    Rows of one group never see each other; with ``grain='day'`` neither do rows
    of one day.
    """
    keys = own_keys(df, keys)
    if grain == "day":
        out = trailing_days(df, keys, day, measures, [None])
        return out.withColumnsRenamed({f"{n}_all": f"{n}_before" for n in measures})
    if hot_keys(df, keys) is None and _whole_numbers(df, measures):
        # Running sum including the whole current group, less that group: one exchange.
        w = Window.partitionBy(*keys).orderBy(day, group)
        peers = Window.partitionBy(*keys, day, group)
        through = lambda c: F.sum(c).over(w.rangeBetween(FIRST, Window.currentRow))
        return df.select("*", *[(through(c) - F.sum(c).over(peers)).alias(f"{n}_before") for n, c in measures.items()])
    from .history import past

    cells = collapse(df, [*keys, group, day], measures)
    cells = history(cells, keys, [day, group], **{f"{n}_before": past("sum", n, default=0) for n in measures})
    return attach(df, cells.drop(*measures), [*keys, group, day])


def smoothed(hits: Column, n: Column, prior: Column, weight: float) -> Column:
    """(hits + weight*prior) / (n + weight)"""
    return (hits + F.lit(float(weight)) * prior) / (n + F.lit(float(weight)))


def variant_index(groups: DataFrame, keys, order, value: str, recent: int = 10) -> DataFrame:
    """Recent level of a condition against its long-term level, from earlier groups only:
    mean and median difference, standard error of the recent mean and 1/(1+error)."""
    from .history import last_k, past

    out = history(
        groups,
        keys,
        order,
        recent_mean=last_k("mean", value, recent),
        recent_median=last_k("quantile", value, recent),
        recent_std=last_k("std", value, recent),
        recent_n=last_k("count", value, recent),
        long_mean=past("mean", value),
        long_median=last_k("quantile", value, 50),
    )
    error = F.try_divide(F.col("recent_std"), F.sqrt(F.col("recent_n")))
    return (
        out.withColumn("variant", F.col("recent_mean") - F.col("long_mean"))
        .withColumn("variant_robust", F.col("recent_median") - F.col("long_median"))
        .withColumn("uncertainty", error)
        .withColumn("confidence", 1 / (1 + error))
        .drop("recent_mean", "recent_median", "recent_std", "recent_n", "long_mean", "long_median")
    )


__all__ = [n for n in dir() if not n.startswith("_")]
