"""Comparisons inside a group: relative statistics, probabilities, pairs and triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide, pairs as P
from ..operators.relative import implied, kernel_sum, leave_one_out, normalise, rank, softmax, standing, top_k, totals
from ..operators.sequential import capped_equity, ratings
from ..plans.registry import query
from ..sources.tables import entries, oracle, with_price
from .histories import ENTITY, K, KEY, PERSON, _pick

G = "(PARTITION BY group_id)"


@query("w21_group_broadcast", oracle(f"""
SELECT {K}, round(avg(qty) OVER {G}, 6) AS mean, round(stddev_samp(qty) OVER {G}, 6) AS std, CAST(sum(qty) OVER {G} AS BIGINT) AS total,
 max(qty) OVER {G} AS top, count(*) OVER {G} AS size FROM entries"""))
def w21(spark, sf):
    q = F.col("qty")
    df = totals(entries(spark, sf), "group_id", mean=F.avg(q), std=F.stddev_samp(q), total=F.sum(q), top=F.max(q), size=F.count(F.lit(1)))
    return _pick(df, mean=F.round("mean", 6), std=F.round("std", 6), total=F.col("total"), top=F.col("top"), size=F.col("size"))


@query("w22_leave_one_out", oracle(f"""
SELECT {K}, CAST(sum(qty) OVER {G} - qty AS BIGINT) AS qty_others_sum, round((sum(qty) OVER {G} - qty) / nullif(count(*) OVER {G} - 1, 0), 6) AS qty_others_mean FROM entries"""))
def w22(spark, sf):
    df = leave_one_out(entries(spark, sf), "group_id", "qty")
    return _pick(df, qty_others_sum=F.col("qty_others_sum"), qty_others_mean=F.round("qty_others_mean", 6))


@query("w23_w24_w26_standing", oracle(f"""
SELECT {K}, round(z, 6) AS z, round(d, 6) AS diff, round(50 + 10 * z, 6) AS dev, round(pct, 6) AS pct, gap FROM (
 SELECT {K}, coalesce((qty - avg(qty) OVER {G}) / nullif(stddev_samp(qty) OVER {G}, 0), 0) AS z, qty - avg(qty) OVER {G} AS d,
 (rank() OVER (PARTITION BY group_id ORDER BY qty) + (count(*) OVER (PARTITION BY group_id, qty) - 1) / 2.0) / count(*) OVER {G} AS pct,
 max(qty) OVER {G} - qty AS gap FROM entries)"""))
def w23(spark, sf):
    df = standing(entries(spark, sf), "group_id", "qty")
    return _pick(df, **{n: F.round(f"qty_{n}", 6) for n in ("z", "diff", "dev", "pct")}, gap=F.col("qty_gap"))


@query("w25_rank_methods", oracle(f"""
SELECT {K}, CASE WHEN x IS NOT NULL THEN row_number() OVER (PARTITION BY group_id ORDER BY x NULLS LAST, line, entity, person_a) END AS first,
 CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY group_id ORDER BY x NULLS LAST) END AS low,
 CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY group_id ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY group_id, x) - 1) / 2.0 END AS average,
 CASE WHEN x IS NOT NULL THEN dense_rank() OVER (PARTITION BY group_id ORDER BY x NULLS LAST) END AS dense
FROM (SELECT *, CASE WHEN disc <> 4 THEN -disc END AS x FROM entries)"""))
def w25(spark, sf):
    x = F.when(F.col("disc") != 4, -F.col("disc"))
    df = rank(entries(spark, sf), "group_id", "first", x, "first", ["line", "entity", "person_a"])
    for name, method in (("low", "min"), ("average", "average"), ("dense", "dense")):
        df = rank(df, "group_id", name, x, method)
    return df.select(*KEY, "first", "low", "average", "dense")


@query("w44_softmax", oracle(f"""
SELECT {K}, round(exp((qty - m) / 7.0) / sum(exp((qty - m) / 7.0)) OVER {G}, 6) AS p FROM (SELECT *, max(qty) OVER {G} AS m FROM entries)"""))
def w44(spark, sf):
    df = softmax(entries(spark, sf), "group_id", "qty", "p", temperature=7.0)
    return _pick(df, p=F.round("p", 6))


@query("w45_normalise", oracle(f"""
SELECT {K}, round(disc / nullif(sum(disc) OVER {G}, 0), 6) AS share FROM entries"""))
def w45(spark, sf):
    return _pick(normalise(entries(spark, sf), "group_id", "disc", "share"), share=F.round("share", 6))


@query("w46_implied_probability", oracle(f"SELECT {K}, round(p_market, 6) AS p_market, round(overround, 8) AS overround FROM priced", priced=True))
def w46(spark, sf):
    return _pick(with_price(entries(spark, sf)), p_market=F.round("p_market", 6), overround=F.round("overround", 8))


@query("w47_ratings")
def w47(spark, sf):
    """Order-dependent ratings; pools are the regions of the buyers' nations."""
    from ..sources.tables import table

    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("person_b"), "c_nationkey")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("pool"))
    df = entries(spark, sf).join(c, "person_b").join(F.broadcast(n), "c_nationkey").select(*KEY, "pool", "day_no", "outcome")
    df = ratings(df, "pool", "group_id", "person_a", "outcome", "day_no", ["line", "entity"])
    df = totals(df, "group_id", field=F.avg("rating"), top=F.max("rating"))
    return _pick(df, rating=F.round("rating", 6), field_mean=F.round("field", 6), gap_to_top=F.round(F.col("top") - F.col("rating"), 6))


def _ledger(spark, sf):
    df = with_price(entries(spark, sf))
    g = df.groupBy("flag", "group_id", "day_no").agg(
        (F.count(F.lit(1)) * 600).cast("double").alias("planned"),
        F.sum(F.when(F.col("outcome") == 1, F.col("qty") * 40).otherwise(0)).cast("double").alias("gross"),
    )
    return g


@query("w48_capped_equity")
def w48(spark, sf):
    """Bankroll fold per strategy over group-level totals, never over raw rows."""
    out = capped_equity(_ledger(spark, sf), "flag", ["day_no", "group_id"], "planned", "gross")
    return out.select("flag", "group_id", "executed", F.round("returned", 4).alias("returned"), F.round("equity", 4).alias("equity"))


@query("w49_equity_with_ruin", oracle("""
SELECT person_a, group_id, line, entity, CAST(equity AS DOUBLE) AS equity, round(greatest(0, least(1, (peak - equity) / peak)), 6) AS drawdown FROM (
 SELECT *, greatest(100000, max(equity) OVER (PARTITION BY person_a ORDER BY day_no, group_id, line, entity ROWS UNBOUNDED PRECEDING)) AS peak FROM (
  SELECT *, CASE WHEN min(raw) OVER (PARTITION BY person_a ORDER BY day_no, group_id, line, entity ROWS UNBOUNDED PRECEDING) <= 0 THEN 0 ELSE raw END AS equity FROM (
   SELECT *, 100000 + sum(profit) OVER (PARTITION BY person_a ORDER BY day_no, group_id, line, entity ROWS UNBOUNDED PRECEDING) AS raw FROM (
    SELECT *, CASE WHEN outcome = 1 THEN qty * 100 ELSE -1000 - 100 * disc END AS profit FROM entries))))"""))
def w49(spark, sf):
    profit = F.when(F.col("outcome") == 1, F.col("qty") * 100).otherwise(-1000 - 100 * F.col("disc"))
    df = entries(spark, sf).withColumn("profit", profit)
    df = decide.equity(df, "person_a", PERSON, "profit", 100000)
    return df.select("person_a", "group_id", "line", "entity", "equity", F.round("drawdown", 6).alias("drawdown"))


# --- pairs ---------------------------------------------------------------------

RUN = "runners AS (SELECT group_id, day_no, person_a AS k, max(p) AS p, min(outcome) AS o FROM (SELECT *, p_market AS p FROM priced) GROUP BY ALL)"


def runners(spark, sf):
    """One row per (group, supplier): the best chance of the supplier in the group."""
    df = with_price(entries(spark, sf))
    return df.groupBy("group_id", "day_no", F.col("person_a").alias("k")).agg(
        F.max("p_market").alias("p"), F.min("outcome").alias("o")
    )


@query("j16_ordered_pairs", oracle("SELECT a.group_id, a.k AS k_1, b.k AS k_2, a.o AS o_1, b.o AS o_2 FROM runners a JOIN runners b ON a.group_id = b.group_id AND a.k <> b.k", RUN, priced=True))
def j16(spark, sf):
    return P.pairs(runners(spark, sf), "group_id", "k", ["o"], "ordered")


@query("j17_unordered_pairs", oracle("SELECT a.group_id, a.k AS k_1, b.k AS k_2 FROM runners a JOIN runners b ON a.group_id = b.group_id AND a.k < b.k", RUN, priced=True))
def j17(spark, sf):
    return P.pairs(runners(spark, sf), "group_id", "k", [], "unordered")


@query("j17_triples", oracle("SELECT group_id, count(*) AS n, CAST(sum(a.k + 3 * b.k + 7 * c.k) AS BIGINT) AS mix FROM runners a JOIN runners b USING (group_id) JOIN runners c USING (group_id) WHERE a.k < b.k AND b.k < c.k GROUP BY group_id", RUN, priced=True))
def j17t(spark, sf):
    t = P.triples(runners(spark, sf), "group_id", "k", [], "unordered")
    return t.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("k_1 + 3 * k_2 + 7 * k_3")).alias("mix"))


@query("j18_pairs_with_repetition", oracle("SELECT a.group_id, a.k AS k_1, b.k AS k_2 FROM runners a JOIN runners b ON a.group_id = b.group_id AND a.k <= b.k", RUN, priced=True))
def j18(spark, sf):
    return P.pairs(runners(spark, sf), "group_id", "k", [], "repeated")


@query("j19_kernel_sum", oracle("""SELECT a.group_id, a.k, round(coalesce(sum(exp(-abs(a.mu - b.mu) / 1.5) * b.p) FILTER (b.k <> a.k), 0), 6) AS congestion
 FROM r a JOIN r b USING (group_id) GROUP BY ALL""", RUN, "r AS (SELECT *, o * 0.7 AS mu FROM runners)", priced=True))
def j19(spark, sf):
    """Exponential kernel over the other rows, by two running sums instead of pairs."""
    df = runners(spark, sf).withColumn("mu", F.col("o") * 0.7)
    df = kernel_sum(df, "group_id", "mu", "p", 1.5, "c")
    return df.select("group_id", "k", (F.round("c", 6) + 0.0).alias("congestion"))


@query("j20_head_to_head", oracle("""
SELECT r.group_id, r.k, CAST(coalesce(sum(m), 0) AS BIGINT) AS vs_matches, round(coalesce(sum(w) / nullif(sum(m), 0), 0), 6) AS vs_win_rate
FROM runners r LEFT JOIN (SELECT k_1, group_id, count(*) OVER e AS m, sum(won) OVER e AS w FROM edges
  WINDOW e AS (PARTITION BY k_1, k_2 ORDER BY day_no, group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) h ON h.group_id = r.group_id AND h.k_1 = r.k
GROUP BY ALL""", RUN, "edges AS (SELECT a.group_id, a.day_no, a.k AS k_1, b.k AS k_2, CAST(a.o < b.o AS INT) AS won FROM runners a JOIN runners b ON a.group_id = b.group_id AND a.k <> b.k)", priced=True))
def j20(spark, sf):
    df = P.head_to_head(runners(spark, sf), "group_id", "day_no", "k", "o")
    return df.select("group_id", "k", F.col("vs_matches").cast("long").alias("vs_matches"), F.round("vs_win_rate", 6).alias("vs_win_rate"))


PAIR = "FROM runners a JOIN runners b ON a.group_id = b.group_id"


@query("d01_exacta", oracle(f"SELECT a.group_id, a.k AS k_1, b.k AS k_2, round(a.p * b.p / (1 - a.p), 6) AS p {PAIR} AND a.k <> b.k", RUN, priced=True))
def d01(spark, sf):
    t = P.pairs(runners(spark, sf), "group_id", "k", ["p"], "ordered")
    return t.select("group_id", "k_1", "k_2", F.round(P.exacta(F.col("p_1"), F.col("p_2")), 6).alias("p"))


@query("d02_quinella", oracle(f"SELECT a.group_id, a.k AS k_1, b.k AS k_2, round(a.p * b.p / (1 - a.p) + a.p * b.p / (1 - b.p), 6) AS p {PAIR} AND a.k < b.k", RUN, priced=True))
def d02(spark, sf):
    t = P.pairs(runners(spark, sf), "group_id", "k", ["p"], "unordered")
    return t.select("group_id", "k_1", "k_2", F.round(P.quinella(F.col("p_1"), F.col("p_2")), 6).alias("p"))


TRI = "a.p * b.p / (1 - a.p) * c.p / (1 - a.p - b.p)"
ORD3 = "runners a JOIN runners b ON a.group_id = b.group_id AND a.k <> b.k JOIN runners c ON c.group_id = a.group_id AND c.k <> a.k AND c.k <> b.k"


@query("d03_trifecta", oracle(f"SELECT a.group_id, a.k AS k_1, b.k AS k_2, c.k AS k_3, round(CASE WHEN 1 - a.p - b.p > 1e-12 THEN {TRI} ELSE 0 END, 6) AS p FROM {ORD3}", RUN, priced=True))
def d03(spark, sf):
    t = P.triples(runners(spark, sf), "group_id", "k", ["p"], "ordered")
    ps = [F.col(f"p_{i}") for i in (1, 2, 3)]
    return t.select("group_id", "k_1", "k_2", "k_3", F.round(P.trifecta(*ps), 6).alias("p"))


@query("d03_trio", oracle(f"""SELECT group_id, list_sort([k_1, k_2, k_3])[1] AS k_1, list_sort([k_1, k_2, k_3])[2] AS k_2, list_sort([k_1, k_2, k_3])[3] AS k_3, round(sum(p), 6) AS p FROM (
 SELECT a.group_id, a.k AS k_1, b.k AS k_2, c.k AS k_3, {TRI} AS p FROM {ORD3}) GROUP BY group_id, list_sort([k_1, k_2, k_3])""", RUN, priced=True))
def d03t(spark, sf):
    t = P.triples(runners(spark, sf), "group_id", "k", ["p"], "unordered")
    ps = [F.col(f"p_{i}") for i in (1, 2, 3)]
    return t.select("group_id", "k_1", "k_2", "k_3", F.round(P.trio(*ps), 6).alias("p"))


@query("d04_both_in_top3", oracle(f"""SELECT group_id, least(x, y) AS key_1, greatest(x, y) AS key_2, round(sum(p), 6) AS p FROM (
 SELECT group_id, x, y, p FROM (SELECT a.group_id, a.k AS k1, b.k AS k2, c.k AS k3, {TRI} AS p FROM {ORD3}),
 LATERAL (VALUES (k1, k2), (k1, k3), (k2, k3)) v(x, y)) GROUP BY 1, 2, 3""", RUN, priced=True))
def d04(spark, sf):
    t = P.both_in_top3(runners(spark, sf), "group_id", "k", "p")
    return t.select("group_id", "key_1", "key_2", F.round("p", 6).alias("p"))


@query("d05_place", oracle(f"""
SELECT r.group_id, r.k, round(p + coalesce(s, 0) + CASE WHEN n > 7 THEN coalesce(t, 0) ELSE 0 END, 6) AS p_place
FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM runners) r
LEFT JOIN (SELECT a.group_id, b.k, sum(a.p * b.p / (1 - a.p)) AS s {PAIR} AND a.k <> b.k GROUP BY ALL) x ON x.group_id = r.group_id AND x.k = r.k
LEFT JOIN (SELECT a.group_id, c.k, sum({TRI}) AS t FROM {ORD3} GROUP BY ALL) y ON y.group_id = r.group_id AND y.k = r.k""", RUN, priced=True))
def d05(spark, sf):
    """Top 2 in groups of up to seven rows, else top 3: second place in closed form,
    third place from pair sums, no triples."""
    df = totals(runners(spark, sf), "group_id", size=F.count(F.lit(1)))
    df = P.second_place(df, "group_id", "p", "p2")
    third = P.third_place(df.filter("size > 7"), "group_id", "k", "p").select("group_id", "k", "p_third")
    df = df.join(third, ["group_id", "k"], "left")
    return df.select("group_id", "k", F.round(F.col("p") + F.col("p2") + F.coalesce("p_third", F.lit(0.0)), 6).alias("p_place"))


@query("d05_bracket_pair", oracle(f"""SELECT group_id, least(f1, f2) AS f_1, greatest(f1, f2) AS f_2, round(sum(p), 6) AS p FROM (
 SELECT a.group_id, a.k % 8 + 1 AS f1, b.k % 8 + 1 AS f2, a.p * b.p / (1 - a.p) AS p {PAIR} AND a.k <> b.k) GROUP BY ALL""", RUN, priced=True))
def d05b(spark, sf):
    t = P.pairs(runners(spark, sf), "group_id", "k", ["p"], "ordered")
    f = [F.col(f"k_{i}") % 8 + 1 for i in (1, 2)]
    t = t.groupBy("group_id", F.least(*f).alias("f_1"), F.greatest(*f).alias("f_2"))
    return t.agg(F.round(F.sum(P.exacta(F.col("p_1"), F.col("p_2"))), 6).alias("p"))


@query("d06_position_probabilities", oracle("""
SELECT group_id, k, round(p, 6) AS p1, round(CASE WHEN count(*) OVER (PARTITION BY group_id) = 1 THEN 0 ELSE p * (sum(p / nullif(1 - p, 0)) OVER (PARTITION BY group_id) - p / nullif(1 - p, 0)) END, 6) AS p2 FROM (
 SELECT group_id, k, exp((o0 - m) / 2.0) / sum(exp((o0 - m) / 2.0)) OVER (PARTITION BY group_id) AS p FROM (
  SELECT *, -o AS o0, max(-o) OVER (PARTITION BY group_id) AS m FROM runners))""", RUN, priced=True))
def d06(spark, sf):
    df = softmax(runners(spark, sf).drop("p").withColumn("s", -F.col("o")), "group_id", "s", "p", temperature=2.0)
    df = P.second_place(df, "group_id", "p", "p2")
    return df.select("group_id", "k", F.round("p", 6).alias("p1"), F.round("p2", 6).alias("p2"))


@query("d07_mass_check", oracle(f"""
SELECT count(*) AS groups, count(*) FILTER (abs(mass - p1) < 1e-6) AS near FROM (
 SELECT group_id, sum(p) AS mass, 1.0 AS p1 FROM (SELECT a.group_id, a.p * b.p / (1 - a.p) AS p {PAIR} AND a.k <> b.k) GROUP BY group_id)""", RUN, priced=True))
def d07(spark, sf):
    """Share of groups whose pair probabilities sum to one."""
    t = P.pairs(runners(spark, sf), "group_id", "k", ["p"], "ordered")
    m = t.groupBy("group_id").agg(F.sum(P.exacta(F.col("p_1"), F.col("p_2"))).alias("mass"))
    return m.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.abs(F.col("mass") - 1) < 1e-6).alias("near"))


@query("d08_synthetic_price", oracle(f"SELECT a.group_id, a.k AS k_1, b.k AS k_2, round(0.775 / (a.p * b.p / (1 - a.p) + a.p * b.p / (1 - b.p)), 4) AS price {PAIR} AND a.k < b.k", RUN, priced=True))
def d08(spark, sf):
    t = P.pairs(runners(spark, sf), "group_id", "k", ["p"], "unordered")
    t = t.withColumn("p", P.quinella(F.col("p_1"), F.col("p_2"))).withColumn("kind", F.lit("umaren"))
    return t.select("group_id", "k_1", "k_2", F.round(decide.synthetic_price("p", "kind"), 4).alias("price"))


CAND = f"""cand AS (SELECT group_id, 'win' AS ticket_type, CAST(k AS VARCHAR) AS combination, p FROM runners
 UNION ALL SELECT a.group_id, 'umaren', CAST(a.k AS VARCHAR) || '-' || CAST(b.k AS VARCHAR), a.p * b.p / (1 - a.p) + a.p * b.p / (1 - b.p) {PAIR} AND a.k < b.k)"""


def candidates(spark, sf, least_pair: float = 1e-4):
    """Win rows all stay; pairs less likely than ``least_pair`` are pruned."""
    r = runners(spark, sf)
    win = r.select("group_id", F.lit("win").alias("ticket_type"), F.col("k").cast("string").alias("combination"), "p")
    two = P.pairs(r, "group_id", "k", ["p"], "unordered")
    two = two.select("group_id", F.lit("umaren").alias("ticket_type"), F.concat_ws("-", "k_1", "k_2").alias("combination"), P.quinella(F.col("p_1"), F.col("p_2")).alias("p"))
    return win.unionByName(two.filter(F.col("p") >= least_pair))


@query("d09_candidates", oracle("SELECT group_id, ticket_type, combination, round(p, 6) AS p FROM cand WHERE ticket_type = 'win' OR p >= 1e-4", RUN, CAND, priced=True))
def d09(spark, sf):
    return candidates(spark, sf).withColumn("p", F.round("p", 6))
