"""Sweeps, bootstrap, calibration fits and walk-forward evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import calibrate as C, decide, metrics as M
from ..operators.relative import normalise, rank
from ..plans.hot import shared_folder
from ..plans.registry import query
from ..sources.io import read_metrics
from .aggregates import LL, model, msql
from .histories import KEY, K, _pick


def _bets(spark, sf):
    return model(spark, sf).select(*KEY, "day", "p_model", "p_market", "y", F.lit(100).alias("stake"), F.when(F.col("y") == 1, F.col("qty") * 20).otherwise(0).alias("payout"))


BETS = "bets AS (SELECT *, 100 AS stake, CASE WHEN y = 1 THEN qty * 20 ELSE 0 END AS payout FROM model)"


@query("a32_bootstrap_interval")
def a32(spark, sf):
    """Poisson bootstrap of the return; weights come from a hash of the row key."""
    out = M.bootstrap_ratio(_bets(spark, sf), KEY, "payout", "stake", 1000, 11)
    return out.select(*[F.round(c, 6).alias(c) for c in ("lower", "mean", "upper")])


SWEEP = "grid AS (SELECT t / 20.0 AS t, s / 100.0 AS s FROM range(0, 10) a(t), (VALUES (100), (95), (90)) b(s))"


@query("a34_d25_parameter_sweep", msql("SELECT t, s, count(*) AS bets, CAST(sum(stake) AS BIGINT) AS stake, round(sum(payout * s), 4) AS payout, round(sum(payout * s) / sum(stake), 6) AS roi FROM bets, grid WHERE p_model * s >= t GROUP BY t, s", BETS, SWEEP))
def a34(spark, sf):
    """Thresholds and price slippage in one aggregation: no row meets a setting."""
    axes = {"t": (F.col("p_model") * F.col("s"), [i / 20.0 for i in range(10)])}
    out = decide.sweep(_bets(spark, sf), axes, F.col("stake"), F.col("payout") * F.col("s"), variants={"s": [1.0, 0.95, 0.9]})
    return out.select("t", "s", "bets", "stake", F.round("payout", 4).alias("payout"), F.round("roi", 6).alias("roi"))


@query("a35_t04_best_configurations", msql("""SELECT t, bets, round(roi, 6) AS roi, round(worst, 6) AS worst FROM (SELECT t, CAST(sum(n) AS BIGINT) AS bets, sum(p) / sum(s) AS roi, min(p / s) AS worst, min(n) AS least FROM (
 SELECT t, year(day) AS y, count(*) AS n, sum(payout) AS p, sum(stake) AS s FROM bets, (SELECT t / 20.0 AS t FROM range(0, 12) a(t)) WHERE p_model >= t GROUP BY ALL) GROUP BY t) WHERE least >= 50 ORDER BY roi DESC, t LIMIT 3""", BETS))
def a35(spark, sf):
    """Configurations whose every year has enough bets, ranked by return."""
    axes = {"t": (F.col("p_model"), [i / 20.0 for i in range(12)])}
    per = decide.sweep(_bets(spark, sf).withColumn("yr", F.year("day")), axes, F.col("stake"), F.col("payout"), by=["yr"])
    out = per.groupBy("t").agg(F.sum("bets").alias("bets"), (F.sum("payout") / F.sum("stake")).alias("roi"), F.min("roi").alias("worst"), F.min("bets").alias("least"))
    return out.filter("least >= 50").orderBy(F.col("roi").desc(), "t").limit(3).select("t", "bets", F.round("roi", 6).alias("roi"), F.round("worst", 6).alias("worst"))


LOGIT = "ln(greatest(1e-6, least(1 - 1e-6, p_model)) / (1 - greatest(1e-6, least(1 - 1e-6, p_model))))"


@query("a36_temperature_grid", msql(f"""SELECT t, round(avg(CASE WHEN y = 1 THEN -ln(greatest(1e-15, q)) ELSE -ln(greatest(1e-15, 1 - q)) END), 6) AS nll FROM (
 SELECT y, t, 1 / (1 + exp(-{LOGIT} / t)) AS q FROM model, (SELECT i / 2.0 AS t FROM range(1, 11) a(i))) GROUP BY t"""))
def a36(spark, sf):
    grid = [i / 2.0 for i in range(1, 11)]
    df = model(spark, sf)
    wide = df.agg(*[F.avg(M.log_loss_of(C.apply_temperature("p_model", t), "y")).alias(f"c{i}") for i, t in enumerate(grid)])
    rows = F.array(*[F.struct(F.lit(t).alias("t"), F.round(f"c{i}", 6).alias("nll")) for i, t in enumerate(grid)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


@query("a36_temperature_fit")
def a36f(spark, sf):
    df = model(spark, sf)
    t = C.temperature(df, "p_model", "y")
    return M.proper_scores(df.withColumn("q", C.apply_temperature("p_model", t)), "q", "y").withColumn("temperature", F.lit(round(t, 4)))


@query("a37_isotonic", msql(f"""SELECT {K}, round(v, 6) AS calibrated FROM (SELECT *, round(p_model, 3) AS s FROM model) JOIN (
 SELECT i, max(least_mean) AS v FROM (SELECT a, b AS i, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS least_mean FROM (
   SELECT x.n AS a, z.n AS b, (z.upto - x.upto + x.t) / (z.w - x.w + x.c) AS mean FROM points x JOIN points z ON x.n <= z.n)) GROUP BY i) ON i = (SELECT n FROM points WHERE points.s = round(p_model, 3))""",
 """points AS MATERIALIZED (SELECT s, row_number() OVER (ORDER BY s) AS n, t, c, CAST(sum(t) OVER (ORDER BY s) AS DOUBLE) AS upto, CAST(sum(c) OVER (ORDER BY s) AS DOUBLE) AS w FROM (
 SELECT round(p_model, 3) AS s, CAST(sum(y) AS DOUBLE) AS t, CAST(count(*) AS DOUBLE) AS c FROM model GROUP BY 1))"""))
def a37(spark, sf):
    """Scores to three digits, so that the definition (the greatest of the least means around a score) can be computed too."""
    df = model(spark, sf).select(*KEY, F.round("p_model", 3).alias("p_model"), "y")
    return _pick(C.apply_isotonic(C.fit_isotonic(df, "p_model", "y"), df, "p_model"), calibrated=F.round("calibrated", 6))


@query("a38_beta_calibration")
def a38(spark, sf):
    df = model(spark, sf).select(*KEY, "p_model", "y")
    a, b, c = C.fit_beta(df, "p_model", "y")
    return _pick(df, calibrated=F.round(C.apply_beta("p_model", a, b, c), 6))


@query("a39_blend_search", msql(f"""SELECT w, round(avg(CASE WHEN y = 1 THEN -ln(greatest(1e-15, least(1 - 1e-15, q))) ELSE -ln(1 - greatest(1e-15, least(1 - 1e-15, q))) END), 6) AS log_loss FROM (
 SELECT y, w, (1 - w) * p_market + w * p_model AS q FROM model, (SELECT i / 10.0 AS w FROM range(0, 11) a(i))) GROUP BY w"""))
def a39(spark, sf):
    df = model(spark, sf)
    grid = [i / 10 for i in range(11)]
    both = normalise(normalise(df, "group_id", "p_market", "a"), "group_id", "p_model", "b")
    wide = both.agg(*[F.avg(M.log_loss_of(C.blend("a", "b", F.lit(w)), "y")).alias(f"c{i}") for i, w in enumerate(grid)])
    rows = F.array(*[F.struct(F.lit(w).alias("w"), F.round(f"c{i}", 6).alias("log_loss")) for i, w in enumerate(grid)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


@query("a40_walk_forward", msql(f"""SELECT y0 AS year, n, round(ll, 6) AS log_loss, w FROM (
 SELECT y0, w, count(*) AS n, avg(CASE WHEN y = 1 THEN -ln(greatest(1e-15, least(1 - 1e-15, q))) ELSE -ln(1 - greatest(1e-15, least(1 - 1e-15, q))) END) AS ll FROM (
  SELECT year(day) AS y0, y, f.w, (1 - f.w) * p_market + f.w * p_model AS q FROM model JOIN (
   SELECT fy, arg_min(w, l) AS w FROM (SELECT fy, w, avg(CASE WHEN y = 1 THEN -ln(greatest(1e-15, least(1 - 1e-15, q))) ELSE -ln(1 - greatest(1e-15, least(1 - 1e-15, q))) END) AS l FROM (
     SELECT fy, w, y, (1 - w) * p_market + w * p_model AS q FROM model, (SELECT i / 5.0 AS w FROM range(0, 6) a(i)), (VALUES (1996), (1997), (1998), (1999), (2000), (2001)) v(fy) WHERE year(day) < fy) GROUP BY fy, w) GROUP BY fy) f ON f.fy = year(day)) GROUP BY y0, w)"""))
def a40(spark, sf):
    """Blend weight fitted on the years before, scored on the year itself."""
    df = model(spark, sf).withColumn("yr", F.year("day"))
    fit = lambda d: C.best_blend(d, "group_id", "p_market", "p_model", "y", steps=5)[0]
    score = lambda d, w: M.proper_scores(d.withColumn("q", C.blend("p_market", "p_model", F.lit(w))), "q", "y").withColumn("w", F.lit(w))
    out = C.walk_forward(df, "yr", list(range(1996, 2002)), fit, score)
    return out.select("year", "n", F.round("log_loss", 6).alias("log_loss"), "w")


@query("a42_leaderboard", msql(f"""SELECT flag, round(roi, 6) AS roi, row_number() OVER (ORDER BY roi DESC NULLS LAST, flag) AS place FROM (
 SELECT flag || status AS flag, CASE WHEN flag || status <> 'NO' THEN sum(payout) / sum(stake) END AS roi FROM bets GROUP BY flag || status)""", BETS))
def a42(spark, sf):
    """Experiment results ranked by return, missing returns last."""
    df = model(spark, sf).withColumn("flag", F.concat("flag", "status"))
    pay = F.when(F.col("y") == 1, F.col("qty") * 20).otherwise(0)
    out = df.groupBy("flag").agg((F.sum(pay) / F.sum(F.lit(100))).alias("roi"))
    out = out.withColumn("roi", F.when(F.col("flag") != "NO", F.col("roi")))
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy(F.col("roi").desc_nulls_last(), "flag")  # one row per experiment
    return out.select("flag", F.round("roi", 6).alias("roi"), F.row_number().over(w).alias("place"))


SHAPES = """shapes AS (SELECT flag || status AS experiment, flag, count(*) AS n, CAST(sum(payout) AS BIGINT) AS pay, CAST(sum(stake) AS BIGINT) AS stake FROM bets GROUP BY ALL)"""


def metric_files(spark, sf):
    """A metric file for each experiment, its shape by experiment: flat, nested, or a list of folds without a return."""
    df = model(spark, sf).groupBy(F.concat("flag", "status").alias("experiment"), "flag").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("y") == 1, F.col("qty") * 20).otherwise(0)).alias("pay"))
    stake, roi = F.col("n") * 100, F.col("pay") / (F.col("n") * 100)
    flat = F.struct(roi.alias("roi"), F.col("n").alias("n_bets"))
    nested = F.struct(F.struct(roi.alias("return"), F.col("n").alias("bets")).alias("metrics"), F.lit("done").alias("state"))
    folds = F.struct(F.array(F.struct(F.col("pay"), stake.alias("stake")), F.struct(F.lit(0).cast("long").alias("pay"), F.lit(None).cast("long").alias("stake"))).alias("folds"), F.lit("failed").alias("state"))
    text = F.when(F.col("flag") == "N", F.to_json(flat)).when(F.col("flag") == "R", F.to_json(nested)).otherwise(F.to_json(folds))
    path = f"{shared_folder(spark)}/metrics-{uuid.uuid4().hex}"
    df.select("experiment", text.alias("value")).repartition("experiment").write.partitionBy("experiment").text(path)
    return read_metrics(spark, path, "experiment")


@query("a42_metric_file_leaves", msql("""SELECT experiment, path, round(number, 6) AS number, text FROM (
 SELECT experiment, unnest(['roi', 'n_bets']) AS path, unnest([pay / stake, n]) AS number, NULL AS text FROM shapes WHERE flag = 'N'
 UNION ALL SELECT experiment, unnest(['metrics.return', 'metrics.bets', 'state']), unnest([pay / stake, n, NULL]), unnest([NULL, NULL, 'done']) FROM shapes WHERE flag = 'R'
 UNION ALL SELECT experiment, unnest(['folds[0].pay', 'folds[0].stake', 'folds[1].pay', 'state']), unnest([pay, stake, 0, NULL]), unnest([NULL, NULL, NULL, 'failed']) FROM shapes WHERE flag = 'A')""", BETS, SHAPES))
def a42l(spark, sf):
    return metric_files(spark, sf).select("experiment", "path", F.round("number", 6).alias("number"), F.when(F.col("number").isNull(), F.col("text")).alias("text"))


@query("a42_metric_file_leaderboard", msql("""SELECT experiment, round(roi, 6) AS roi, bets, row_number() OVER (ORDER BY roi DESC NULLS LAST, experiment) AS place FROM (
 SELECT experiment, CASE WHEN flag <> 'A' THEN pay / stake END AS roi, CASE WHEN flag <> 'A' THEN CAST(n AS DOUBLE) END AS bets FROM shapes)""", BETS, SHAPES))
def a42b(spark, sf):
    """Experiments by return, read from files that name and nest their measures differently."""
    out = M.leaderboard(metric_files(spark, sf), "experiment", {"roi": ["roi", "metrics.return"], "bets": ["n_bets", "metrics.bets"]}, "roi")
    return out.withColumn("roi", F.round("roi", 6))


@query("x05_batch_scoring", msql(f"SELECT {K}, round(CAST(0.3 * qty + 0.7 * disc AS DOUBLE), 6) AS score FROM model"))
def x05(spark, sf):
    """Any vectorised predictor over Arrow batches."""
    df = model(spark, sf).select(*KEY, "qty", "disc")
    return _pick(C.score_in_batches(df, lambda p: 0.3 * p["qty"] + 0.7 * p["disc"], ["qty", "disc"]), score=F.round("score", 6))
