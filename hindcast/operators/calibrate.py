"""Fitting a few numbers to probabilities: temperature, logistic, isotonic, blend weight.

Grids are data: every candidate value is scored in the same aggregation, then the
grid is narrowed around the best one.  Only the few candidate losses reach the
driver.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import logit, sigmoid
from .isotonic import isotonic_blocks, isotonic_value
from .metrics import log_loss_of
from .relative import normalise


def grid_losses(df: DataFrame, loss, candidates: list[float]) -> list[float]:
    """Mean loss of every candidate in one pass: ``loss(candidate)`` is a Column.

    Rows meet the candidates inside the task and leave it as one partial mean per
    candidate.
    """
    grid = F.explode(F.array(*[F.lit(float(c)) for c in candidates])).alias("__g")
    rows = df.select("*", grid).groupBy("__g").agg(F.avg(loss(F.col("__g"))).alias("l")).collect()
    found = {r["__g"]: r["l"] for r in rows}  # one row per candidate
    return [float("inf") if found.get(float(c)) is None else found[float(c)] for c in candidates]


def minimise(df: DataFrame, loss, lo: float, hi: float, points: int = 25, rounds: int = 4) -> float:
    """Minimum of a smooth one-dimensional mean loss by narrowing grids.

    The input is read once per round, so it is kept while the search runs.
    """
    df = df.persist()
    try:
        for _ in range(rounds):
            step = (hi - lo) / (points - 1)
            grid = [lo + step * i for i in range(points)]
            losses = grid_losses(df, loss, grid)
            best = grid[losses.index(min(losses))]
            lo, hi = max(lo, best - step), min(hi, best + step)
    finally:
        df.unpersist()
    return best


def temperature(df: DataFrame, p: str, y: str, lo: float = 0.1, hi: float = 5.0) -> float:
    """T minimising the log loss of sigmoid(logit(p) / T)."""
    return minimise(df.select(p, y), lambda t: log_loss_of(sigmoid(logit(p) / t), y), lo, hi)


def apply_temperature(p: str, t: float) -> Column:
    return sigmoid(logit(p) / F.lit(t))


def _log_features(df: DataFrame, p: str, eps: float = 1e-6) -> DataFrame:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p)))
    df = df.withColumn("__lp", F.log(q)).withColumn("__lq", F.log(1 - q))
    return VectorAssembler(inputCols=["__lp", "__lq"], outputCol="__x").transform(df)


def fit_beta(df: DataFrame, p: str, y: str, max_iter: int = 100):
    """sigmoid(a ln p + b ln(1-p) + c) as a two-feature logistic regression."""
    lr = LogisticRegression(featuresCol="__x", labelCol=y, maxIter=max_iter, tol=1e-9, standardization=True)
    m = lr.fit(_log_features(df, p))
    a, b = (float(v) for v in m.coefficients)
    return a, b, float(m.intercept)


def apply_beta(p: str, a: float, b: float, c: float, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p)))
    out = sigmoid(F.lit(a) * F.log(q) + F.lit(b) * F.log(1 - q) + F.lit(c))
    return F.greatest(F.lit(eps), F.least(F.lit(1 - eps), out))


def fit_isotonic(df: DataFrame, p: str, y: str) -> DataFrame:
    """Monotone map of scores to rates: a table of blocks."""
    return isotonic_blocks(df, p, y)


def apply_isotonic(model: DataFrame, df: DataFrame, p: str) -> DataFrame:
    out = isotonic_value(df, model, p, "calibrated")
    return out.withColumn("calibrated", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated"))))


def blend(a, b, weight) -> Column:
    """(1 - weight) * a + weight * b."""
    return (1 - weight) * F.col(a) + weight * F.col(b)


def best_blend(df: DataFrame, group: str, p_market: str, p_model: str, y: str, steps: int = 20) -> tuple[float, list[float]]:
    """Blend weight with the lowest log loss.

    Both inputs are normalised per group once; a blend of two distributions that
    sum to one sums to one, so no weight needs its own normalisation pass.
    """
    both = normalise(normalise(df, group, p_market, "__a"), group, p_model, "__b").dropna(subset=["__a", "__b"])
    grid = [i / steps for i in range(steps + 1)]
    losses = grid_losses(both, lambda w: log_loss_of(blend("__a", "__b", w), y), grid)
    return grid[losses.index(min(losses))], losses


def walk_forward(df: DataFrame, year: str, years: list[int], fit, evaluate) -> DataFrame:
    """Fit on the years before y, evaluate on y, one row set per year (few years, one job each)."""
    out = None
    for y in years:
        params = fit(df.filter(F.col(year) < y))
        part = evaluate(df.filter(F.col(year) == y), params).withColumn("year", F.lit(y))
        out = part if out is None else out.unionByName(part)
    return out


def score_in_batches(df: DataFrame, predict, columns: list[str], output: str = "score") -> DataFrame:
    """Apply any vectorised predictor ``predict(pandas frame) -> array`` to Arrow batches."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{output}` double"

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{output: predict(pdf[columns])})

    return df.mapInPandas(run, schema)
