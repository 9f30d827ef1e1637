"""Statistics of a row against its own group (all competitors of one event)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.hot import hot_keys, match, tag_hot
from .calendar import attach
from .history import history, past, seq


def _list(x) -> list:
    return [x] if isinstance(x, str) else list(x)


def totals(df: DataFrame, group, **aggs: Column) -> DataFrame:
    """Add group aggregates to every row.

    One exchange by group; groups too big for a task are aggregated map-side and
    their few result rows broadcast back.
    """
    group = _list(group)
    hot = hot_keys(df, group)
    w = Window.partitionBy(*group)
    over = [c.over(w).alias(n) for n, c in aggs.items()]
    if hot is None:
        return df.select("*", *over)
    cold, heavy = tag_hot(df, hot)
    side = heavy.groupBy(*group).agg(*[c.alias(n) for n, c in aggs.items()])
    joined = heavy.alias("l").join(F.broadcast(side.alias("r")), match(group))
    return cold.select("*", *over).unionByName(joined.select("l.*", *[F.col(f"r.{n}") for n in aggs]))


def rank(df: DataFrame, group, name: str, by: Column, method: str = "min", ties=()) -> DataFrame:
    """Rank inside the group by ascending ``by``; NULL stays NULL.

    ``min`` | ``average`` | ``dense`` share a rank among equals, ``first`` breaks
    ties by the ``ties`` columns.
    """
    group = _list(group)
    df = df.withColumn("__by", by)
    hot = hot_keys(df, group)
    if hot is None:
        w = Window.partitionBy(*group).orderBy(F.col("__by").asc_nulls_last(), *ties)
        if method == "first":
            value = F.row_number().over(w)
        elif method == "dense":
            value = F.dense_rank().over(w)
        else:
            value = F.rank().over(w)
            if method == "average":
                same = F.count(F.lit(1)).over(Window.partitionBy(*group, F.col("__by")))
                value = value + (same - 1) / 2.0
        return df.select("*", F.when(F.col("__by").isNotNull(), value).alias(name)).drop("__by")
    if method == "first":
        out = history(df, group, ["__by", *ties], __before=seq())
        out = totals(out, group, __nulls=F.count_if(F.col("__by").isNull()))
        value = (F.col("__before") - F.col("__nulls") + 1).cast("int")
        return out.withColumn(name, F.when(F.col("__by").isNotNull(), value)).drop("__by", "__before", "__nulls")
    cells = df.filter(F.col("__by").isNotNull()).groupBy(*group, "__by").agg(F.count(F.lit(1)).alias("__same"))
    cells = history(cells, group, "__by", __less=past("sum", "__same", default=0), __kinds=seq())
    value = {
        "min": (F.col("__less") + 1).cast("int"),
        "average": F.col("__less") + 1 + (F.col("__same") - 1) / 2.0,
        "dense": (F.col("__kinds") + 1).cast("int"),
    }[method]
    return attach(df, cells.select(*group, "__by", value.alias(name)), [*group, "__by"]).drop("__by")


def top_k(df: DataFrame, group, by: Column, k: int, ties=()) -> DataFrame:
    """The k best rows of each group (ascending ``by``), every row whole."""
    group = _list(group)
    w = Window.partitionBy(*group).orderBy(by, *ties)
    return df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k).drop("__k")


def leave_one_out(df: DataFrame, group, col: str) -> DataFrame:
    """``<col>_others_sum`` and ``<col>_others_mean`` over the other rows of the group."""
    x = F.col(col)
    out = totals(df, group, __s=F.sum(x), __n=F.count(x))
    rest = F.coalesce(F.col("__s"), F.lit(0)) - F.coalesce(x, F.lit(0))
    n = F.col("__n") - x.isNotNull().cast("int")
    return (
        out.withColumn(f"{col}_others_sum", rest)
        .withColumn(f"{col}_others_mean", F.try_divide(rest, n))
        .drop("__s", "__n")
    )


def standing(df: DataFrame, group, col: str) -> DataFrame:
    """z-score (0 when the group does not vary), difference from the mean, deviation
    score 50+10z, percentile rank (average of ties over n) and gap to the best."""
    group = _list(group)
    x = F.col(col)
    out = totals(df, group, __m=F.avg(x), __d=F.stddev_samp(x), __n=F.count(x), __b=F.max(x))
    out = rank(out, group, "__r", x, "average")
    z = F.when(x.isNotNull(), F.coalesce(F.try_divide(x - F.col("__m"), F.col("__d")), F.lit(0.0)))
    return (
        out.withColumn(f"{col}_z", z)
        .withColumn(f"{col}_diff", x - F.col("__m"))
        .withColumn(f"{col}_dev", 50 + 10 * F.col(f"{col}_z"))
        .withColumn(f"{col}_pct", F.col("__r") / F.col("__n"))
        .withColumn(f"{col}_gap", F.col("__b") - x)
        .drop("__m", "__d", "__n", "__b", "__r")
    )


def softmax(df: DataFrame, group, score: str, name: str = "p", temperature: float = 1.0) -> DataFrame:
    """exp(score/T) normalised inside the group, shifted by the group maximum."""
    out = totals(df, group, __top=F.max(score))
    out = out.withColumn("__e", F.exp((F.col(score) - F.col("__top")) / F.lit(float(temperature))))
    return normalise(out, group, "__e", name).drop("__top", "__e")


def normalise(df: DataFrame, group, col: str, name: str) -> DataFrame:
    """Scale to sum 1 inside the group; NULL where the group sums to 0."""
    out = totals(df, group, __sum=F.sum(col))
    return out.withColumn(name, F.try_divide(F.col(col), F.nullif(F.col("__sum"), F.lit(0.0)))).drop("__sum")


def implied(df: DataFrame, group, price: str) -> DataFrame:
    """``p_market`` = (1/price) / overround and ``overround`` = sum of 1/price."""
    out = df.withColumn("__q", F.when(F.col(price) > 0, 1.0 / F.col(price)))
    out = totals(out, group, overround=F.sum("__q"))
    return out.withColumn("p_market", F.try_divide(F.col("__q"), F.col("overround"))).drop("__q")


def kernel_sum(df: DataFrame, group, at: str, weight: str, scale: float, name: str) -> DataFrame:
    """Sum over the other rows j of weight_j * exp(-|at - at_j| / scale).

    The kernel factors on either side of a row, so two running sums over the
    sorted group replace the pair join: rows on the left contribute
    exp(-at/scale) * sum(w_j * exp(at_j/scale)), rows on the right the mirror image.
    Values are taken relative to the group mean to keep the exponents small.
    """
    group = _list(group)
    out = totals(df, group, __mid=F.avg(at))
    u = (F.col(at) - F.col("__mid")) / F.lit(float(scale))
    out = out.withColumn("__u", u).withColumn("__up", F.col(weight) * F.exp(u)).withColumn("__dn", F.col(weight) * F.exp(-u))
    # Cells meet their rows by the position as given: the mean may differ in its last bit when it is computed again.
    cells = out.groupBy(*group, F.col(at).alias("__at")).agg(
        F.sum("__up").alias("__cu"), F.sum("__dn").alias("__cd"), F.sum(weight).alias("__cw"), F.min("__u").alias("__u")
    )
    cells = history(cells.withColumn("__neg", -F.col("__at")), group, "__at", __left=past("sum", "__cu", default=0.0))
    cells = history(cells, group, "__neg", __right=past("sum", "__cd", default=0.0))
    side = cells.select(
        *group, "__at", (F.exp(-F.col("__u")) * F.col("__left") + F.exp(F.col("__u")) * F.col("__right") + F.col("__cw")).alias("__all")
    )
    out = attach(out.withColumn("__at", F.col(at)), side, [*group, "__at"])
    return out.withColumn(name, F.col("__all") - F.col(weight)).drop("__at", "__mid", "__u", "__up", "__dn", "__all")
