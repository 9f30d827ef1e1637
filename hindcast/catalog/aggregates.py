"""Aggregations and evaluation metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scalars import PRICE_EDGES, cut
from ..operators.quantiles import exact_quantiles, group_quantiles
from ..operators import audit, metrics as M
from ..operators.calendar import collapse
from ..operators.history import history, past
from ..operators.relative import rank, softmax, totals
from ..operators.state import StateTable
from ..plans.hot import shared_folder
from ..plans.registry import query
from ..sources.tables import entries, oracle, table, with_price
from .histories import K, KEY, top3, win, _pick

MODEL = """model AS (SELECT *, exp((qty - mx) / 10.0) / sum(exp((qty - mx) / 10.0)) OVER (PARTITION BY group_id) AS p_model, CAST(outcome = 1 AS INTEGER) AS y,
 CASE WHEN outcome = 1 THEN 1 ELSE 0 END AS win FROM (SELECT *, max(qty) OVER (PARTITION BY group_id) AS mx FROM priced))"""


def model(spark, sf):
    """Entries with a market probability, a model probability and the win label."""
    df = softmax(with_price(entries(spark, sf)), "group_id", "qty", "p_model", temperature=10.0)
    return df.withColumn("y", win())


def msql(body, *ctes):
    return oracle(body, MODEL, *ctes, priced=True)


@query("a01_group_moments", oracle("SELECT flag, status, count(*) AS n, CAST(sum(qty) AS BIGINT) AS total, round(avg(qty), 6) AS mean, round(stddev_samp(qty), 6) AS std, min(qty) AS lo, max(qty) AS hi FROM entries GROUP BY ALL"))
def a01(spark, sf):
    q = F.col("qty")
    return entries(spark, sf).groupBy("flag", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum(q).alias("total"), F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_samp(q), 6).alias("std"), F.min(q).alias("lo"), F.max(q).alias("hi"))


@query("a02_a03_daily_conditional_counts", oracle("SELECT person_a, flag, day, count(*) AS n, CAST(count(*) FILTER (outcome = 1) AS BIGINT) AS wins, CAST(count(*) FILTER (outcome <= 3) AS BIGINT) AS top3 FROM entries GROUP BY ALL"), dates=('day',))
def a02(spark, sf):
    return collapse(entries(spark, sf), ["person_a", "flag", "day"], {"n": F.lit(1), "wins": win(), "top3": top3()})


@query("a04_distinct_counts", oracle("SELECT flag, count(DISTINCT group_id) AS groups, count(DISTINCT entity) AS entities FROM entries GROUP BY flag"))
def a04(spark, sf):
    return entries(spark, sf).groupBy("flag").agg(F.countDistinct("group_id").alias("groups"), F.countDistinct("entity").alias("entities"))


@query("a05_frequencies", oracle("SELECT disc, count(*) AS n, round(count(*) / (SELECT count(*) FROM entries), 6) AS share FROM entries GROUP BY disc ORDER BY n DESC, disc LIMIT 5"))
def a05(spark, sf):
    df = entries(spark, sf)
    total = df.agg(F.count(F.lit(1)).alias("t"))
    top = df.groupBy("disc").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "disc").limit(5)
    return top.join(F.broadcast(total)).select("disc", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY p_model DESC, line, entity, person_a) AS r FROM model) WHERE r = 1)"


@query("a06_a23_top1_hit_and_return", msql("SELECT count(*) AS groups, CAST(sum(y) AS BIGINT) AS hits, round(sum(y) / count(*), 6) AS hit_rate, round(sum(CASE WHEN y = 1 THEN 1 / p_market ELSE 0 END) / count(*), 6) AS roi FROM best", BEST))
def a06(spark, sf):
    b = M.best_first(model(spark, sf), "group_id", "p_model", ["line", "entity", "person_a"])
    n = F.count(F.lit(1))
    return b.agg(n.alias("groups"), F.sum("y").alias("hits"), F.round(F.sum("y") / n, 6).alias("hit_rate"),
                 F.round(F.sum(F.when(F.col("y") == 1, 1 / F.col("p_market")).otherwise(0.0)) / n, 6).alias("roi"))


@query("a07_category_entropy", oracle("""SELECT group_id, round(-sum(p * ln(p)), 6) + 0.0 AS entropy, count(*) AS kinds FROM (
 SELECT group_id, flag, count(*) / sum(count(*)) OVER (PARTITION BY group_id) AS p FROM entries GROUP BY group_id, flag) GROUP BY group_id"""))
def a07(spark, sf):
    c = entries(spark, sf).groupBy("group_id", "flag").agg(F.count(F.lit(1)).alias("c"))
    c = totals(c, "group_id", t=F.sum("c")).withColumn("p", F.col("c") / F.col("t"))
    return c.groupBy("group_id").agg((F.round(M.entropy("p"), 6) + 0.0).alias("entropy"), F.count(F.lit(1)).alias("kinds"))


@query("a08_a09_a43_group_decision_features", msql("""
SELECT group_id, round(-sum(p_model * ln(p_model)), 6) + 0.0 AS entropy, round(stddev_pop(p_market), 6) AS price_std, round(max(p_model), 6) AS p1,
 round(max(p_model) - coalesce(max(p_model) FILTER (r = 2), max(p_model)), 6) AS margin, round(sum(p_model) FILTER (r <= 5), 6) AS top5, count(*) AS size, max(y) FILTER (r = 1) AS label
FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY p_model DESC, line, entity, person_a) AS r FROM model) GROUP BY group_id"""))
def a08(spark, sf):
    df = rank(model(spark, sf), "group_id", "r", -F.col("p_model"), "first", ["line", "entity", "person_a"])
    at = lambda k: F.max(F.when(F.col("r") == k, F.col("p_model")))
    return df.groupBy("group_id").agg(
        (F.round(M.entropy("p_model"), 6) + 0.0).alias("entropy"), F.round(F.stddev_pop("p_market"), 6).alias("price_std"), F.round(at(1), 6).alias("p1"),
        F.round(at(1) - F.coalesce(at(2), at(1)), 6).alias("margin"), F.round(F.sum(F.when(F.col("r") <= 5, F.col("p_model"))), 6).alias("top5"),
        F.count(F.lit(1)).alias("size"), F.max(F.when(F.col("r") == 1, F.col("y"))).alias("label"))


@query("a10_top5_pivot", msql("SELECT group_id, max(line) FILTER (r = 1) AS k1, max(line) FILTER (r = 2) AS k2, max(line) FILTER (r = 3) AS k3, max(line) FILTER (r = 4) AS k4, max(line) FILTER (r = 5) AS k5 FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY p_model DESC, line, entity, person_a) AS r FROM model) GROUP BY group_id"))
def a10(spark, sf):
    df = rank(model(spark, sf), "group_id", "r", -F.col("p_model"), "first", ["line", "entity", "person_a"])
    return df.groupBy("group_id").agg(*[F.max(F.when(F.col("r") == k, F.col("line"))).alias(f"k{k}") for k in range(1, 6)])


A11 = """SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS venue, MAX(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS main, COUNT(*) AS n
FROM orders GROUP BY CAST(o_orderdate AS DATE), o_orderpriority ORDER BY day DESC, venue LIMIT 40"""


@query("a11_conditional_max_sql", A11, dates=('day',))
def a11(spark, sf):
    return spark.sql(A11.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders"))


@query("a12_group_quantiles", oracle("SELECT flag, " + ", ".join(f"round(quantile_cont(cents, {q}), 4) AS p{n}" for n, q in ((1, .01), (5, .05), (50, .5), (95, .95), (99, .99))) + " FROM entries GROUP BY flag"))
def a12(spark, sf):
    qs = [(1, .01), (5, .05), (50, .5), (95, .95), (99, .99)]
    out = group_quantiles(entries(spark, sf), ["flag"], {f"p{n}": (F.col("cents"), q) for n, q in qs})
    return out.select("flag", *[F.round(f"p{n}", 4).alias(f"p{n}") for n, _ in qs])


BANDS = [f"{a}-{b}" for a, b in zip(PRICE_EDGES, PRICE_EDGES[1:])]
BAND_SQL = "CASE " + " ".join(f"WHEN fair >= {a} AND fair < {b} THEN '{a}-{b}'" for a, b in zip(PRICE_EDGES, PRICE_EDGES[1:])) + " END"


@query("a13_price_band_table", msql(f"""
SELECT band, count(*) AS n, count(DISTINCT group_id) AS groups, round(avg(y), 6) AS win_rate, round(avg(p_model), 6) AS mean_model, round(avg(p_market), 6) AS mean_market, round(avg(fair), 4) AS mean_price,
 round(avg(-ln(CASE WHEN y = 1 THEN greatest(1e-15, least(1 - 1e-15, p_model)) ELSE 1 - greatest(1e-15, least(1 - 1e-15, p_model)) END)), 6) AS ll_model,
 round(sum(CASE WHEN y = 1 THEN fair ELSE 0 END) / count(*), 6) AS roi, round(count(*) / nullif(sum(y), 0), 6) AS fair_price, max(e) AS ece
FROM (SELECT *, {BAND_SQL} AS band FROM fairs) JOIN (SELECT band, round(sum(abs(mp - mr) * n) / (max(t)), 6) AS e FROM (
   SELECT band, b, avg(p_model) AS mp, avg(y) AS mr, count(*) AS n, max(t) AS t FROM (SELECT *, CAST(ceil(p_model * 10) AS INTEGER) AS b, count(*) OVER (PARTITION BY band) AS t FROM (SELECT *, {BAND_SQL} AS band FROM fairs)) WHERE p_model > 0 GROUP BY band, b) GROUP BY band) USING (band)
WHERE band IS NOT NULL GROUP BY band HAVING count(*) >= 100""", "fairs AS (SELECT *, round(1 / p_market, 9) AS fair FROM model)"))
def a13(spark, sf):
    df = model(spark, sf).withColumn("fair", F.round(1 / F.col("p_market"), 9))
    t = M.band_table(df, cut("fair", PRICE_EDGES, BANDS, right=False), "group_id", "y", "fair", "p_model", "p_market")
    six = ["win_rate", "mean_model", "mean_market", "ll_model", "roi", "fair_price", "ece"]
    return t.select("band", "n", "groups", F.round("mean_price", 4).alias("mean_price"), *[F.round(c, 6).alias(c) for c in six])


@query("a14_monthly_rollup", oracle("""SELECT CAST(date_trunc('month', day) AS DATE) AS month, count(*) AS bets, round(sum(CASE WHEN outcome = 1 THEN qty ELSE 0 END) / count(*), 6) AS roi FROM entries GROUP BY 1"""), dates=('month',))
def a14(spark, sf):
    return entries(spark, sf).groupBy(F.trunc("day", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("bets"), F.round(F.sum(F.when(F.col("outcome") == 1, F.col("qty")).otherwise(0)) / F.count(F.lit(1)), 6).alias("roi"))


@query("a14_yearly_folds", oracle("""SELECT count(*) AS folds, round(min(roi), 6) AS worst, round(stddev_samp(roi), 6) AS std FROM (
 SELECT year(day) AS y, sum(CASE WHEN outcome = 1 THEN qty ELSE 0 END) / count(*) AS roi FROM entries GROUP BY 1)"""))
def a14y(spark, sf):
    per = entries(spark, sf).groupBy(F.year("day").alias("y")).agg((F.sum(F.when(F.col("outcome") == 1, F.col("qty")).otherwise(0)) / F.count(F.lit(1))).alias("roi"))
    return per.agg(F.count(F.lit(1)).alias("folds"), F.round(F.min("roi"), 6).alias("worst"), F.round(F.stddev_samp("roi"), 6).alias("std"))


@query("a15_group_sum_diagnostics", oracle("""SELECT count(*) AS groups, count(*) FILTER (abs(s - 1) <= 0.01) AS near01, count(*) FILTER (abs(s - 1) <= 0.05) AS near05, count(*) FILTER (s = 0) AS zero, count(*) FILTER (s > 1.5) AS high, round(max(s), 6) AS top
 FROM (SELECT group_id, sum(disc) / 20.0 AS s FROM entries GROUP BY group_id)"""))
def a15(spark, sf):
    g = entries(spark, sf).groupBy("group_id").agg((F.sum("disc") / 20.0).alias("s"))
    d = F.abs(F.col("s") - 1)
    return g.agg(F.count(F.lit(1)).alias("groups"), F.count_if(d <= 0.01).alias("near01"), F.count_if(d <= 0.05).alias("near05"), F.count_if(F.col("s") == 0).alias("zero"),
                 F.count_if(F.col("s") > 1.5).alias("high"), F.round(F.max("s"), 6).alias("top"))


CLIP = "greatest(1e-15, least(1 - 1e-15, {}))"
LL = "CASE WHEN y = 1 THEN -ln({0}) ELSE -ln(1 - {0}) END".format(CLIP.format("p_model"))


@query("a16_log_loss_brier", msql(f"SELECT flag, count(*) AS n, round(avg({LL}), 6) AS log_loss, round(avg(power(p_model - y, 2)), 6) AS brier FROM model GROUP BY flag"))
def a16(spark, sf):
    df = M.proper_scores(model(spark, sf), "p_model", "y", ["flag"])
    return df.select("flag", "n", F.round("log_loss", 6).alias("log_loss"), F.round("brier", 6).alias("brier"))


@query("a17_auc", oracle("""SELECT flag, round((sum(r) FILTER (y = 1) - p * (p + 1) / 2.0) / (p * (n - p)), 6) AS auc FROM (
 SELECT flag, y, rank() OVER (PARTITION BY flag ORDER BY qty) + (count(*) OVER (PARTITION BY flag, qty) - 1) / 2.0 AS r, sum(y) OVER (PARTITION BY flag) AS p, count(*) OVER (PARTITION BY flag) AS n
 FROM (SELECT flag, qty, CAST(outcome = 1 AS INTEGER) AS y FROM entries)) GROUP BY flag, p, n"""))
def a17(spark, sf):
    df = M.auc(entries(spark, sf).withColumn("y", win()), "qty", "y", ["flag"])
    return df.select("flag", F.round("auc", 6).alias("auc"))


@query("a18_coverage", oracle("SELECT year(day) AS year, count(*) AS n, count(*) FILTER (x > 0) AS valid, count(*) FILTER (x IS NULL) AS missing, count(*) FILTER (x = 0) AS zero, count(*) FILTER (x < 0) AS negative FROM (SELECT *, CASE WHEN flag <> 'A' THEN disc - 1 END AS x FROM entries) GROUP BY 1"))
def a18(spark, sf):
    df = entries(spark, sf).select(F.year("day").alias("year"), F.when(F.col("flag") != "A", F.col("disc") - 1).alias("x"))
    return audit.coverage(df, "x", ["year"])


BIN = "bins AS (SELECT CAST(ceil(p_model * 10) AS INTEGER) AS bin, count(*) AS n, avg(p_model) AS mean_p, avg(y) AS rate FROM model WHERE p_model > 0 AND p_model <= 1 GROUP BY 1)"


@query("a19_ece", msql("SELECT round(sum(abs(mean_p - rate) * n) / (SELECT count(*) FROM model), 6) AS ece FROM bins", BIN))
def a19(spark, sf):
    return M.ece(model(spark, sf), "p_model", "y").select(F.round("ece", 6).alias("ece"))


@query("a20_calibration_curve", msql("SELECT bin, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate FROM bins", BIN))
def a20(spark, sf):
    return M.calibration_bins(model(spark, sf), "p_model", "y").select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("rate", 6).alias("rate"))


@query("a21_ndcg_recall", oracle("""
SELECT group_id, size, recall, round(CASE WHEN size > 1 THEN coalesce(dcg / nullif(idcg, 0), 0) END, 6) AS ndcg FROM (
 SELECT group_id, count(*) AS size, max(CAST(outcome <= 3 AS INTEGER)) FILTER (r <= 5) AS recall, sum(g / log2(r + 1)) FILTER (r <= 5) AS dcg, sum(g / log2(i + 1)) FILTER (i <= 5) AS idcg FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY qty DESC, line, entity, person_a) AS r, row_number() OVER (PARTITION BY group_id ORDER BY g DESC, line, entity, person_a) AS i
  FROM (SELECT *, CASE WHEN outcome <= 18 THEN 1.0 / outcome ELSE 0 END AS g FROM entries)) GROUP BY group_id)"""))
def a21(spark, sf):
    gain = F.when(F.col("outcome") <= 18, 1.0 / F.col("outcome")).otherwise(0.0)
    out = M.ranking_quality(entries(spark, sf), "group_id", F.col("qty"), gain, F.col("outcome") <= 3, 5, ["line", "entity", "person_a"])
    return out.withColumn("ndcg", F.round("ndcg", 6))


@query("a22_winner_nll", msql("SELECT round(avg(-ln(p_model)), 6) AS winner_nll, count(*) AS winners FROM model WHERE outcome = 1"))
def a22(spark, sf):
    return M.winner_nll(model(spark, sf), "p_model", "outcome").withColumn("winner_nll", F.round("winner_nll", 6))


@query("a25_duplicate_keys", "SELECT count(*) FILTER (c > 1) AS dup_keys, CAST(sum(c - 1) AS BIGINT) AS surplus, round(sum(c - 1) / sum(c), 6) AS rate FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def a25(spark, sf):
    out = audit.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    return out.withColumn("rate", F.round("rate", 6))


@query("a26_overround_statistics", oracle("""SELECT round(min(o) * 1000, 5) AS lo, round(avg(o) * 1000, 5) AS mean, round(max(o) * 1000, 5) AS hi, count(*) FILTER (o > 0.01) AS extreme FROM (SELECT group_id, sum(1 / price) AS o FROM priced GROUP BY group_id)""", priced=True))
def a26(spark, sf):
    g = with_price(entries(spark, sf)).groupBy("group_id").agg(F.first("overround").alias("o"))
    o = F.col("o")
    return g.agg(F.round(F.min(o) * 1000, 5).alias("lo"), F.round(F.avg(o) * 1000, 5).alias("mean"), F.round(F.max(o) * 1000, 5).alias("hi"), F.count_if(o > 0.01).alias("extreme"))


@query("a26_extreme_groups", oracle("""SELECT group_id, string_agg(CAST(cents AS VARCHAR), ',' ORDER BY cents) AS top3 FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY cents) AS r, sum(1 / price) OVER (PARTITION BY group_id) AS o FROM priced0) WHERE r <= 3 AND o > 0.01 GROUP BY group_id""", priced=True))
def a26b(spark, sf):
    df = rank(with_price(entries(spark, sf)).filter("overround > 0.01"), "group_id", "r", F.col("cents"), "first", ["line", "entity", "person_a"])
    return df.filter("r <= 3").groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("cents")), lambda x: x.cast("string")), ",").alias("top3"))


FEATURES = ["qty", "disc", "tax", "cents", "line"]


@query("a27_target_correlations", oracle(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, outcome), 6) AS r, CAST(abs(corr({c}, outcome)) > 0.3 AS INTEGER) AS alarm FROM entries" for c in FEATURES)))
def a27(spark, sf):
    wide = entries(spark, sf).agg(*[F.corr(c, "outcome").alias(c) for c in FEATURES])
    out = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in FEATURES])).alias("s")).select("s.*")
    return out.select("feature", F.round("r", 6).alias("r"), (F.abs("r") > 0.3).cast("int").alias("alarm"))


SIDE = "sided AS (SELECT *, CAST(day >= DATE '2000-01-01' AS INTEGER) AS side FROM entries)"


def _sided(spark, sf):
    return entries(spark, sf).withColumn("side", (F.col("day") >= F.lit("2000-01-01").cast("date")).cast("int"))


@query("a28_drift_moments", oracle("""SELECT round(avg(cents) FILTER (side = 1) - avg(cents) FILTER (side = 0), 3) AS mean_shift, round(stddev_samp(cents) FILTER (side = 1) - stddev_samp(cents) FILTER (side = 0), 3) AS std_shift,
 round(quantile_cont(cents, 0.05) FILTER (side = 1) - quantile_cont(cents, 0.05) FILTER (side = 0), 3) AS q05, round(quantile_cont(cents, 0.95) FILTER (side = 1) - quantile_cont(cents, 0.95) FILTER (side = 0), 3) AS q95 FROM sided""", SIDE))
def a28(spark, sf):
    df = _sided(spark, sf)
    tails = group_quantiles(df, ["side"], {"q05": (F.col("cents"), 0.05), "q95": (F.col("cents"), 0.95)})
    both = df.groupBy("side").agg(F.avg("cents").alias("mean"), F.stddev_samp("cents").alias("std")).join(tails, "side")
    shift = lambda c: F.max(F.when(F.col("side") == 1, F.col(c))) - F.max(F.when(F.col("side") == 0, F.col(c)))
    return both.agg(*[F.round(shift(c), 3).alias(n) for c, n in (("mean", "mean_shift"), ("std", "std_shift"), ("q05", "q05"), ("q95", "q95"))])


@query("a28_ks_statistic", oracle("""SELECT round(max(abs(ca / na - cb / nb)), 6) AS ks FROM (SELECT sum(a) OVER (ORDER BY cents) AS ca, sum(b) OVER (ORDER BY cents) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM (
 SELECT cents, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM sided GROUP BY cents))""", SIDE))
def a28k(spark, sf):
    return M.ks_statistic(_sided(spark, sf), "side", "cents").select(F.round("ks", 6).alias("ks"))


@query("a29_psi", oracle("""SELECT round(sum((a / na - b / nb) * ln((a / na + 1e-4) / (b / nb + 1e-4))), 6) AS psi FROM (SELECT bin, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b, max(na) AS na, max(nb) AS nb FROM (
 SELECT side, len(list_filter(e, lambda x: cents >= x)) AS bin, count(*) FILTER (side = 0) OVER () AS na, count(*) FILTER (side = 1) OVER () AS nb FROM sided, (SELECT quantile_cont(cents, [.1, .2, .3, .4, .5, .6, .7, .8, .9]) AS e FROM sided WHERE side = 0)) GROUP BY bin)""", SIDE))
def a29(spark, sf):
    return M.psi(_sided(spark, sf), "side", "cents").select(F.round("psi", 6).alias("psi"))


@query("a30_error_correlation", msql("SELECT round(corr(abs(p_model - y), qty), 6) AS r_qty, round(corr(abs(p_model - y), disc), 6) AS r_disc FROM model"))
def a30(spark, sf):
    e = F.abs(F.col("p_model") - F.col("y"))
    return model(spark, sf).agg(F.round(F.corr(e, "qty"), 6).alias("r_qty"), F.round(F.corr(e, "disc"), 6).alias("r_disc"))


@query("a31_null_zero_scan", oracle(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER ({c} = 0) AS zeros FROM (SELECT qty, disc, nullif(tax, 3) AS tax FROM entries)" for c in ("qty", "disc", "tax"))))
def a31(spark, sf):
    df = entries(spark, sf).select("qty", "disc", F.nullif(F.col("tax"), F.lit(3)).alias("tax"))
    return M.profile(df, ["qty", "disc", "tax"])


@query("a33_incremental_state", oracle("""SELECT entity, count(*) AS n, CAST(count(*) FILTER (outcome = 1) AS BIGINT) AS wins FROM entries GROUP BY entity"""))
def a33(spark, sf):
    """State of the old days plus the counts of the new days equals the state of all days."""
    df = entries(spark, sf)
    cut = "DATE '2000-01-01'"
    old = collapse(df.filter(f"day < {cut}"), ["entity"], {"n0": F.lit(1), "w0": win()})
    new = collapse(df.filter(f"day >= {cut}"), ["entity"], {"n1": F.lit(1), "w1": win()})
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return old.join(new, "entity", "full").select("entity", (z("n0") + z("n1")).alias("n"), (z("w0") + z("w1")).alias("wins"))


BATCH = "CAST(greatest(0, least(2, year(day) - 1995)) AS INTEGER)"


@query("a33_batches_read_before_write", oracle(f"""SELECT {K}, batch, r.n, r.wins, r.best FROM (SELECT *, {BATCH} AS batch FROM entries) e LEFT JOIN (
 SELECT b, person_a AS k, count(*) AS n, CAST(count(*) FILTER (outcome = 1) AS BIGINT) AS wins, min(outcome) AS best FROM (SELECT *, {BATCH} AS own FROM entries), (VALUES (1), (2)) t(b) WHERE own < b GROUP BY ALL) r ON r.b = batch AND r.k = person_a"""))
def a33b(spark, sf):
    """Three batches of days, the second one twice: each row sees the state before its batch."""
    df = entries(spark, sf).withColumn("batch", F.greatest(F.lit(0), F.least(F.lit(2), F.year("day") - 1995)))
    table = StateTable(f"{shared_folder(spark)}/state-{uuid.uuid4().hex}", ["person_a"], {"n": ("count", F.lit(1)), "wins": ("sum", win()), "best": ("min", F.col("outcome"))}, buckets=16)
    out = [table.apply(df.filter(F.col("batch") == b), f"batch-{b}") for b in (0, 1, 1, 2)]
    every = out[0].unionByName(out[2]).unionByName(out[3])
    return every.select(*KEY, "batch", "n", "wins", "best")


@query("a41_closing_line_value", oracle("""SELECT count(*) AS n, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.05), 6) AS p5, round(quantile_cont(r, 0.95), 6) AS p95 FROM (SELECT cents / (100.0 * qty * (1 + disc)) AS r FROM entries WHERE outcome <= 2)"""))
def a41(spark, sf):
    r = F.col("cents") / (100.0 * F.col("qty") * (1 + F.col("disc")))
    df = entries(spark, sf).filter("outcome <= 2").select(r.alias("r"))
    found = exact_quantiles(df, {n: (F.col("r"), p) for n, p in (("median", 0.5), ("p5", 0.05), ("p95", 0.95))})
    q = [F.round(F.lit(v).cast("double"), 6).alias(n) for n, v in found.items()]
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 6).alias("mean"), *q)


@query("a44_target_encoding", oracle(f"""SELECT {K}, round((s + 20.0 * g) / (n + 20.0), 6) AS te, round(coalesce((s - os + 20.0 * g) / (n - oc + 20.0), g), 6) AS te_fold FROM (
 SELECT {K}, sum(y) OVER (PARTITION BY entity) AS s, count(*) OVER (PARTITION BY entity) AS n, sum(y) OVER (PARTITION BY entity, group_id % 5) AS os, count(*) OVER (PARTITION BY entity, group_id % 5) AS oc, avg(y) OVER () AS g
 FROM (SELECT *, CAST(outcome = 1 AS INTEGER) AS y FROM entries))"""))
def a44(spark, sf):
    df = entries(spark, sf).withColumn("y", win())
    plain = M.target_encoding(df, "entity", "y", 20).withColumnRenamed("entity_te", "te")
    fold = M.target_encoding(plain, "entity", "y", 20, folds=F.col("group_id") % 5)
    return _pick(fold, te=F.round("te", 6), te_fold=F.round("entity_te", 6))
