"""Evaluation: probabilities against outcomes, ranking quality, drift and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .history import history, past, seq
from .quantiles import exact_quantiles
from .relative import rank, totals

EPS = 1e-15


def clipped(p) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))


def log_loss_of(p, y) -> Column:
    """Per-row log loss."""
    p, y = clipped(p), (F.col(y) if isinstance(y, str) else y)
    return F.when(y == 1, -F.log(p)).otherwise(-F.log(1 - p))


def proper_scores(df: DataFrame, p: str, y: str, by: list[str] = ()) -> DataFrame:
    pv, yv = F.col(p), F.col(y)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(log_loss_of(p, y)).alias("log_loss"), F.avg((pv - yv) * (pv - yv)).alias("brier")
    )


def auc(df: DataFrame, score: str, y: str, by: list[str] = ()) -> DataFrame:
    """Exact area under the ROC curve by the rank sum with average ranks for ties.

    Scores are first counted per distinct value; the ordered part runs over the
    distinct values and is split like any history when there are too many.
    """
    cells = df.groupBy(*by, score).agg(F.sum(y).alias("__pos"), F.count(F.lit(1)).alias("__n"))
    keys = list(by)
    if not keys:
        cells, keys = cells.withColumn("__all", F.lit(0)), ["__all"]
    cells = history(cells, keys, F.col(score).cast("double"), __less=past("sum", "__n", default=0))
    mid = F.col("__less") + (F.col("__n") + 1) / 2.0
    agg = cells.groupBy(*by).agg(F.sum(mid * F.col("__pos")).alias("r"), F.sum("__pos").alias("p"), F.sum("__n").alias("n"))
    value = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0))
    return agg.select(*by, value.alias("auc"))


def calibration_bins(df: DataFrame, p: str, y: str, bins: int = 10, by: list[str] = ()) -> DataFrame:
    """Equal-width bins (lo, hi]; p = 0 belongs to none.  One row per non-empty bin."""
    b = F.ceil(F.col(p) * bins).cast("int")
    return (
        df.filter((F.col(p) > 0) & (F.col(p) <= 1)).groupBy(*by, b.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))
    )


def ece(df: DataFrame, p: str, y: str, bins: int = 10, by: list[str] = ()) -> DataFrame:
    """Expected calibration error; the share of a bin is taken over all rows."""
    per = calibration_bins(df, p, y, bins, by)
    gap = per.groupBy(*by).agg(F.sum(F.abs(F.col("mean_p") - F.col("rate")) * F.col("n")).alias("g"))
    total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("t"))
    out = gap.join(total, list(by)) if by else gap.join(F.broadcast(total))
    return out.select(*by, (F.col("g") / F.col("t")).alias("ece"))


def ranking_quality(df: DataFrame, group: str, score: Column, gain: Column, good: Column, k: int, ties=()) -> DataFrame:
    """Per group: NDCG@k with the given gain and whether a good row is among the top k.

    Groups of one row have no ranking and get NULL NDCG.
    """
    df = df.withColumn("__gain", gain).withColumn("__good", good.cast("int"))
    df = rank(df, group, "__r", -score, "first", ties)
    df = rank(df, group, "__i", -F.col("__gain"), "first", ties)
    part = lambda r: F.sum(F.when(F.col(r) <= k, F.col("__gain") / F.log2(F.col(r) + 1.0)))
    out = df.groupBy(group).agg(
        part("__r").alias("__dcg"), part("__i").alias("__idcg"), F.count(F.lit(1)).alias("size"),
        F.max(F.when(F.col("__r") <= k, F.col("__good"))).alias("recall"),
    )
    value = F.when(F.col("size") > 1, F.coalesce(F.try_divide("__dcg", F.nullif(F.col("__idcg"), F.lit(0.0))), F.lit(0.0)))
    return out.select(group, value.alias("ndcg"), "recall", "size")


def winner_nll(df: DataFrame, p: str, outcome: str) -> DataFrame:
    return df.filter(F.col(outcome) == 1).agg(F.avg(-F.log(clipped(p))).alias("winner_nll"), F.count(F.lit(1)).alias("winners"))


def entropy(p) -> Column:
    """Aggregate: -sum p ln p over the positive values."""
    p = F.col(p) if isinstance(p, str) else p
    return -F.sum(F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0)))


def best_first(df: DataFrame, group: str, p: str, ties: list[str]) -> DataFrame:
    """The row with the highest p of each group."""
    rest = [c for c in df.columns if c != group]
    order = F.struct(F.col(p), *[(-F.col(t)).alias(f"t{i}") for i, t in enumerate(ties)])
    return df.groupBy(group).agg(F.max_by(F.struct(*rest), order).alias("__b")).select(group, "__b.*")


def band_table(df: DataFrame, band: Column, group: str, y: str, price: str, p_model: str, p_market: str, least: int = 100) -> DataFrame:
    """Per price band: size, rates, fair price, log losses, ECE and flat-stake return.
    Bands with fewer than ``least`` rows are left out."""
    df = df.withColumn("band", band).filter(F.col("band").isNotNull())
    win = F.col(y).cast("double")
    flat = df.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(group).alias("groups"), F.avg(win).alias("win_rate"),
        F.avg(p_model).alias("mean_model"), F.avg(p_market).alias("mean_market"), F.avg(price).alias("mean_price"),
        F.avg(log_loss_of(p_model, y)).alias("ll_model"), F.avg(log_loss_of(p_market, y)).alias("ll_market"),
        (F.sum(F.when(F.col(y) == 1, F.col(price))) / F.count(F.lit(1))).alias("roi"),
    ).filter(F.col("n") >= least)
    return flat.join(ece(df, p_model, y, by=["band"]), "band").withColumn("fair_price", F.try_divide(F.lit(1.0), F.col("win_rate")))


def ks_statistic(df: DataFrame, side: str, x: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic between side = 0 and side = 1."""
    cells = df.groupBy(x).agg(F.count_if(F.col(side) == 0).alias("a"), F.count_if(F.col(side) == 1).alias("b")).withColumn("__all", F.lit(0))
    cells = history(cells, "__all", F.col(x).cast("double"), ca=past("sum", "a", default=0), cb=past("sum", "b", default=0))
    total = cells.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gap = F.abs((F.col("ca") + F.col("a")) / F.col("na") - (F.col("cb") + F.col("b")) / F.col("nb"))
    return cells.join(F.broadcast(total)).agg(F.max(gap).alias("ks"))


def quantile_edges(df: DataFrame, x: str, bins: int) -> list[float]:
    """Distinct linear-interpolated quantile edges (bins+1 numbers on the driver)."""
    found = exact_quantiles(df, {str(i): (F.col(x), i / bins) for i in range(bins + 1)})
    return sorted({v for v in found.values() if v is not None})


def quantile_bin(x, edges: list[float]) -> Column:
    """0-based bin by the edges: first bin closed on both ends, the others (lo, hi]."""
    x = F.col(x) if isinstance(x, str) else x
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        out = F.when(x <= F.lit(edges[i + 1]), F.lit(i)).otherwise(out)
    return F.when(x >= F.lit(edges[0]), out)


def psi(df: DataFrame, side: str, x: str, bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """Population stability index of side 1 against side 0, bins from side 0's quantiles
    [lo, hi) with open outer ends."""
    edges = quantile_edges(df.filter(F.col(side) == 0), x, bins)[1:-1]
    b = F.lit(0)
    for e in edges:
        b = b + (F.col(x) >= F.lit(e)).cast("int")
    cells = df.groupBy(b.alias("bin")).agg(F.count_if(F.col(side) == 0).alias("a"), F.count_if(F.col(side) == 1).alias("b"))
    total = cells.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    a, c = F.col("a") / F.col("na"), F.col("b") / F.col("nb")
    return cells.join(F.broadcast(total)).agg(F.sum((a - c) * F.log((a + eps) / (c + eps))).alias("psi"))


def bootstrap_ratio(df: DataFrame, row_id: list[str], num: str, den: str, resamples: int, seed: int, by: list[str] = ()) -> DataFrame:
    """Poisson bootstrap interval of sum(num)/sum(den).

    Every row gets an independent Poisson(1) weight per resample, derived from a
    hash of its key, so the result does not depend on partitioning.  Rows are
    expanded inside the map side; only one partial sum per resample leaves a task.
    """
    b = F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b")
    rows = df.select(*by, *row_id, num, den, b)
    u = (F.xxhash64(*row_id, "b", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    # Cumulative Poisson(1) probabilities.
    steps, term, cum = [], 0.36787944117144233, 0.0
    for k in range(0, 12):
        cum += term
        steps.append(cum)
        term /= k + 1
    # The hash is taken once a row and resample, below the comparisons; they end at the first probability it stays under.
    rows = rows.withColumn("__u", u)
    weight = F.lit(len(steps))
    for k in reversed(range(len(steps))):
        weight = F.when(F.col("__u") <= steps[k], F.lit(k)).otherwise(weight)
    rows = rows.select(*by, "b", num, den, weight.alias("__w"))
    weight = F.col("__w")
    sums = rows.groupBy(*by, "b").agg(F.sum(weight * F.col(num)).alias("x"), F.sum(weight * F.col(den)).alias("y"))
    r = F.try_divide("x", "y")
    return sums.groupBy(*by).agg(
        F.percentile(r, F.lit(0.025)).alias("lower"), F.percentile(r, F.lit(0.975)).alias("upper"), F.avg(r).alias("mean")
    )


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL and zero share of every column in one wide aggregate, then one row per column."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in columns:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__null"), F.count_if(F.col(c).cast("double") == 0).alias(f"{c}__zero")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col("__n").alias("n"), F.col(f"{c}__null").alias("nulls"), F.col(f"{c}__zero").alias("zeros")) for c in columns]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def target_encoding(df: DataFrame, key: str, y: str, weight: float, folds: Column | None = None) -> DataFrame:
    """Smoothed mean of y per key: (sum + weight*global) / (n + weight).

    With ``folds`` each row is encoded from the other folds only (totals minus
    the own fold's totals), unseen keys take the global mean.
    """
    total = df.agg(F.avg(y).alias("__g"))
    per = df.groupBy(key).agg(F.sum(y).alias("__s"), F.count(y).alias("__n"))
    out = df.join(F.broadcast(total)).join(per, key, "left")
    if folds is not None:
        own = df.withColumn("__f", folds).groupBy(key, "__f").agg(F.sum(y).alias("__os"), F.count(y).alias("__on"))
        out = out.withColumn("__f", folds).join(own, [key, "__f"], "left")
        s, n = F.col("__s") - F.col("__os"), F.col("__n") - F.col("__on")
    else:
        s, n = F.col("__s"), F.col("__n")
    value = F.coalesce((s + F.lit(float(weight)) * F.col("__g")) / (n + F.lit(float(weight))), F.col("__g"))
    return out.withColumn(f"{key}_te", value).drop("__g", "__s", "__n", "__f", "__os", "__on")


def leaderboard(leaves: DataFrame, name: str, measures: dict[str, list[str]], by: str) -> DataFrame:
    """One row per experiment from the leaves of its metric files: every measure from the first of its paths that has a
    number, and ``place`` by ``by``, the highest first, experiments without it last, ties by name."""
    at = lambda path: F.max(F.when(F.col("path") == path, F.col("number")))
    out = leaves.groupBy(name).agg(*[F.coalesce(*[at(p) for p in paths]).alias(m) for m, paths in measures.items()])
    w = Window.partitionBy(F.lit(0)).orderBy(F.col(by).desc_nulls_last(), name)  # one row per experiment
    return out.withColumn("place", F.row_number().over(w))
