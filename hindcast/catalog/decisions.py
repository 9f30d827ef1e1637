"""Selection, staking, tickets, settlement and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import decide as D, metrics as M, pairs as P
from ..operators.history import history, past
from ..operators.relative import rank, top_k, totals
from ..plans.hot import deal
from ..plans.registry import query
from ..sources.tables import entries, oracle
from .aggregates import MODEL, model, msql
from .histories import K, KEY, _pick

TIES = ["line", "entity", "person_a"]
SCORED = """scored AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY p_model DESC, line, entity, person_a) AS r,
 round(0.8 / p_market, 3) AS odds, round(p_model, 4) AS p FROM model), evs AS (SELECT *, round(p * odds, 8) AS ev FROM scored)"""


def scored(spark, sf):
    """Rows with a rounded probability, a fair price less the take, EV and score rank."""
    df = rank(model(spark, sf), "group_id", "r", -F.col("p_model"), "first", TIES)
    df = df.withColumn("odds", F.round(0.8 / F.col("p_market"), 3)).withColumn("p", F.round("p_model", 4))
    return df.withColumn("ev", F.round(D.expected_value("p", "odds"), 8))


def ssql(body, *ctes):
    return oracle(body, MODEL, SCORED, *ctes, priced=True)


@query("d10_expected_value_and_edge", ssql(f"SELECT {K}, ev, round(p - p_market, 6) AS edge FROM evs"))
def d10(spark, sf):
    return _pick(scored(spark, sf), ev=F.col("ev"), edge=F.round(F.col("p") - F.col("p_market"), 6))


@query("d11_threshold_selection", ssql(f"SELECT {K} FROM (SELECT *, max(p) OVER (PARTITION BY group_id) - coalesce(max(p) FILTER (r = 2) OVER (PARTITION BY group_id), 0) AS margin, count(*) OVER (PARTITION BY group_id) AS size FROM evs) WHERE ev >= 0.9 AND odds BETWEEN 1.5 AND 30 AND p >= 0.1 AND r <= 2 AND margin >= 0.05 AND size <= 18"))
def d11(spark, sf):
    df = totals(scored(spark, sf), "group_id", top=F.max("p"), second=F.max(F.when(F.col("r") == 2, F.col("p"))), size=F.count(F.lit(1)))
    df = df.withColumn("margin", F.col("top") - F.coalesce("second", F.lit(0.0)))
    return df.filter("ev >= 0.9 AND odds BETWEEN 1.5 AND 30 AND p >= 0.1 AND r <= 2 AND margin >= 0.05 AND size <= 18").select(*KEY)


KELLY = "CASE WHEN odds > 1 THEN greatest(0.0, (p * odds - 1) / (odds - 1)) ELSE 0.0 END"


@query("d12_kelly_stake", ssql(f"SELECT {K}, round({KELLY}, 6) AS f, CAST(floor(1000000.0 * least(0.05, {KELLY} * 0.1) / 100) * 100 AS BIGINT) AS stake FROM evs"))
def d12(spark, sf):
    return _pick(scored(spark, sf), f=F.round(D.kelly("p", "odds"), 6), stake=D.kelly_stake("p", "odds", 1_000_000))


KIND = "kinds AS (SELECT *, CASE flag WHEN 'A' THEN 'win' WHEN 'N' THEN 'umaren' ELSE 'wide' END AS kind FROM evs)"
PORT = """port0 AS (SELECT *, CAST(floor(100000.0 * (greatest(0.0, least(1.0, (ev - 1.0) / greatest(0.1, odds - 1.0))) * 0.1) / 100) * 100 AS BIGINT) AS amount FROM kinds
 WHERE ev >= CASE kind WHEN 'win' THEN 1.1 WHEN 'umaren' THEN 1.2 ELSE 1.0 END), port AS (SELECT *, CAST(sum(amount) OVER (PARTITION BY group_id) AS BIGINT) AS total FROM port0 WHERE amount >= 100)"""


@query("d13_portfolio", ssql(f"SELECT {K}, a AS amount FROM (SELECT *, CASE WHEN total > 3000 THEN CAST(floor(amount * (3000.0 / total) / 100) * 100 AS BIGINT) ELSE amount END AS a FROM port) WHERE a >= 100", KIND, PORT))
def d13(spark, sf):
    df = scored(spark, sf).withColumn("kind", S.lookup("flag", {"A": "win", "N": "umaren"}, "wide"))
    out = D.portfolio(df, "group_id", "kind", "odds", "ev", {"win": 1.1, "umaren": 1.2}, budget=3000.0)
    return out.select(*KEY, "amount")


@query("d14_budget_trim", ssql(f"""
SELECT {K}, amount - take AS amount FROM (SELECT *, greatest(0, least(amount, cut - gone)) AS take FROM (
 SELECT *, CAST(ceil(greatest(0, total - 2000) / 100.0) * 100 AS BIGINT) AS cut, CAST(coalesce(sum(amount) OVER (PARTITION BY group_id ORDER BY ev, line, entity, person_a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS gone FROM port)) WHERE amount - take > 0""", KIND, PORT))
def d14(spark, sf):
    df = scored(spark, sf).withColumn("kind", S.lookup("flag", {"A": "win", "N": "umaren"}, "wide"))
    df = D.portfolio(df, "group_id", "kind", "odds", "ev", {"win": 1.1, "umaren": 1.2}, budget=1e12)
    return D.trim_to_budget(df, "group_id", "amount", "ev", 2000, ties=TIES).select(*KEY, "amount")


@query("d15_equal_split", ssql(f"""
SELECT {K}, CAST(greatest(100, least(2000, floor(600.0 / n / 100) * 100)) AS BIGINT) AS amount FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS n,
 row_number() OVER (PARTITION BY group_id ORDER BY ev DESC, line, entity, person_a) AS k FROM evs WHERE ev > 0.5) WHERE floor(600.0 / n / 100) >= 1 OR k <= 6"""))
def d15(spark, sf):
    return D.equal_split(scored(spark, sf), "group_id", "ev", 600, 2000, 0.5, ties=TIES).select(*KEY, "amount")


@query("d16_box_tickets", ssql("SELECT a.group_id, a.line AS l1, b.line AS l2, a.entity AS e1, b.entity AS e2 FROM scored a JOIN scored b ON a.group_id = b.group_id AND a.r < b.r WHERE b.r <= 4"))
def d16(spark, sf):
    top = scored(spark, sf).filter("r <= 4")
    t = P.pairs(top, "group_id", "r", ["line", "entity"], "unordered")
    return t.select("group_id", F.col("line_1").alias("l1"), F.col("line_2").alias("l2"), F.col("entity_1").alias("e1"), F.col("entity_2").alias("e2"))


@query("d16_box_permutations", ssql("SELECT a.group_id, a.r AS r1, b.r AS r2, c.r AS r3 FROM scored a JOIN scored b ON a.group_id = b.group_id AND a.r <> b.r JOIN scored c ON a.group_id = c.group_id AND c.r <> a.r AND c.r <> b.r WHERE a.r <= 3 AND b.r <= 3 AND c.r <= 3"))
def d16p(spark, sf):
    t = P.triples(scored(spark, sf).filter("r <= 3"), "group_id", "r", [], "ordered")
    return t.select("group_id", *[F.col(f"r_{i}").alias(f"r{i}") for i in (1, 2, 3)])


@query("d17_formation_tickets", ssql("""SELECT DISTINCT a.group_id, array_to_string(list_sort([a.r, b.r, c.r]), '-') AS selection FROM scored a JOIN scored b ON a.group_id = b.group_id JOIN scored c ON a.group_id = c.group_id
 WHERE a.r IN (1, 2) AND b.r IN (1, 2, 3) AND c.r IN (2, 3, 4, 5) AND a.r <> b.r AND a.r <> c.r AND b.r <> c.r"""))
def d17(spark, sf):
    t = P.formation(scored(spark, sf), "group_id", "r", "r", [[1, 2], [1, 2, 3], [2, 3, 4, 5]], ordered=False)
    return t.select("group_id", S.combination("selection", ordered=False).alias("selection"))


PROPOSALS = """proposals AS (SELECT *, row_number() OVER (PARTITION BY day, amount > 0 ORDER BY group_id) AS nth FROM (
 SELECT group_id, day, CASE WHEN p >= 0.8 AND ev >= 0.8 THEN 'high' WHEN p >= 0.5 AND ev >= 0.5 THEN 'balanced' WHEN p >= 0.4 THEN 'frequent' END AS strategy,
  CASE WHEN p >= 0.8 AND ev >= 0.8 THEN 1000 WHEN p >= 0.5 AND ev >= 0.5 THEN 500 WHEN p >= 0.4 THEN 100 ELSE 0 END AS amount FROM evs WHERE r = 1)),
fold AS (SELECT group_id, day, strategy, amount, nth, CAST(amount <= 3000 AS INTEGER) AS bought, CASE WHEN amount <= 3000 THEN amount ELSE 0 END AS spent FROM proposals WHERE amount > 0 AND nth = 1
 UNION ALL SELECT p.group_id, p.day, p.strategy, p.amount, p.nth, CAST(f.spent + p.amount <= 3000 AS INTEGER), f.spent + CASE WHEN f.spent + p.amount <= 3000 THEN p.amount ELSE 0 END
 FROM fold f JOIN proposals p ON p.day = f.day AND p.nth = f.nth + 1 AND p.amount > 0)"""


@query("d18_rule_cascade_with_caps", ssql("SELECT group_id, day, strategy, amount, bought FROM fold UNION ALL SELECT group_id, day, strategy, amount, 0 FROM proposals WHERE amount = 0", PROPOSALS).replace("WITH ", "WITH RECURSIVE ", 1), dates=('day',))
def d18(spark, sf):
    """Priority rules exclude each other; groups of a day are bought in order while they fit the day cap."""
    df = scored(spark, sf).filter("r = 1")
    p, ev = F.col("p"), F.col("ev")
    df = D.cascade(df, [("high", (p >= 0.8) & (ev >= 0.8), 1000), ("balanced", (p >= 0.5) & (ev >= 0.5), 500), ("frequent", p >= 0.4, 100)])
    return D.day_cap(df, "day", ["group_id"], "amount", 3000).select("group_id", "day", "strategy", "amount", "bought")


@query("d19_segment_strategy", ssql("""SELECT group_id, CASE WHEN size < 4 THEN 'skip' WHEN pop1 >= 4 THEN 'axis4' ELSE 'pass' END AS strategy FROM (
 SELECT group_id, count(*) AS size, max(pop) FILTER (r = 1) AS pop1 FROM (SELECT *, rank() OVER (PARTITION BY group_id ORDER BY odds) AS pop FROM scored) GROUP BY group_id)"""))
def d19(spark, sf):
    df = rank(scored(spark, sf), "group_id", "pop", F.col("odds"), "min")
    g = df.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), F.max(F.when(F.col("r") == 1, F.col("pop"))).alias("pop1"))
    return g.select("group_id", F.when(F.col("size") < 4, "skip").when(F.col("pop1") >= 4, "axis4").otherwise("pass").alias("strategy"))


SETTLE = """tick AS (SELECT group_id, day, 'win' AS bet_type, CAST(line AS VARCHAR) AS sel, 100 * (1 + disc) AS stake, odds FROM evs WHERE r <= 2),
 pay AS (SELECT group_id, 'win' AS bet_type, CAST(line AS VARCHAR) AS sel, qty * 30 AS payout FROM entries WHERE outcome = 1),
 unit AS (SELECT group_id, bet_type, sel, sum(payout) AS u FROM pay GROUP BY ALL),
 ledger AS (SELECT t.*, coalesce(CAST(floor(stake / 100.0 * u) AS BIGINT), 0) AS payout, CAST(u IS NOT NULL AS INTEGER) AS is_hit FROM tick t LEFT JOIN unit USING (group_id, bet_type, sel))"""


def ledger(spark, sf):
    """Tickets on the two best rows, bought at the decision price, paid from the result table."""
    win = F.lit("win").alias("bet_type")
    t = scored(spark, sf).filter("r <= 2").select("group_id", "day", win, F.col("line").cast("string").alias("sel"), (100 * (1 + F.col("disc"))).alias("stake"), "odds")
    pay = entries(spark, sf).filter("outcome = 1").select("group_id", win, F.col("line").cast("string").alias("sel"), (F.col("qty") * 30).alias("payout"))
    return D.settle(t, pay, ["group_id", "bet_type", "sel"])


@query("d20_d22_settlement", ssql("SELECT group_id, sel, stake, odds, payout, is_hit FROM ledger", SETTLE))
def d20(spark, sf):
    return ledger(spark, sf).select("group_id", "sel", "stake", "odds", "payout", "is_hit")


HIT = """SELECT a.group_id, a.line AS l1, b.line AS l2, CAST(a.outcome <= 2 AND b.outcome <= 2 AND a.outcome <> b.outcome AS INTEGER) AS quinella,
 CAST(a.outcome = 1 AND b.outcome = 2 AS INTEGER) AS exacta, CAST(a.outcome <= 3 AND b.outcome <= 3 AS INTEGER) AS wide, CAST(a.outcome <= CASE WHEN a.n <= 7 THEN 2 ELSE 3 END AS INTEGER) AS place
FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM scored) a JOIN scored b ON a.group_id = b.group_id WHERE a.r = 1 AND b.r = 2"""


@query("d21_hit_tests", ssql(HIT))
def d21(spark, sf):
    """Hits by ticket type straight from the outcomes of the two best rows, no pair join."""
    df = totals(scored(spark, sf), "group_id", n=F.count(F.lit(1)))
    at = lambda c, k: F.max(F.when(F.col("r") == k, F.col(c)))
    g = df.groupBy("group_id").agg(at("line", 1).alias("l1"), at("line", 2).alias("l2"), at("outcome", 1).alias("o1"), at("outcome", 2).alias("o2"), F.max("n").alias("n")).filter("l2 IS NOT NULL")
    o1, o2 = F.col("o1"), F.col("o2")
    i = lambda c: c.cast("int")
    return g.select("group_id", "l1", "l2", i((o1 <= 2) & (o2 <= 2) & (o1 != o2)).alias("quinella"), i((o1 == 1) & (o2 == 2)).alias("exacta"),
                    i((o1 <= 3) & (o2 <= 3)).alias("wide"), i(o1 <= F.when(F.col("n") <= 7, 2).otherwise(3)).alias("place"))


@query("d23_ledger_summary", ssql("SELECT year(day) AS year, count(*) AS bets, CAST(sum(stake) AS BIGINT) AS stake, CAST(sum(payout) AS BIGINT) AS payout, CAST(sum(payout) - sum(stake) AS BIGINT) AS profit, round(sum(payout) / sum(stake), 6) AS roi, round(avg(CAST(payout > 0 AS INTEGER)), 6) AS hit_rate FROM ledger GROUP BY 1", SETTLE))
def d23(spark, sf):
    out = D.summary(ledger(spark, sf).withColumn("year", F.year("day")), "stake", "payout", ["year"])
    return out.select("year", "bets", "stake", "payout", "profit", F.round("roi", 6).alias("roi"), F.round("hit_rate", 6).alias("hit_rate"))


@query("d24_period_aggregation", ssql("SELECT CAST(date_trunc('month', day) AS DATE) AS month, count(DISTINCT day) AS days, CAST(sum(stake) AS BIGINT) AS stake, CAST(sum(payout) AS BIGINT) AS payout FROM ledger GROUP BY 1", SETTLE), dates=('month',))
def d24(spark, sf):
    df = ledger(spark, sf)
    return df.groupBy(F.trunc("day", "month").alias("month")).agg(F.countDistinct("day").alias("days"), F.sum("stake").alias("stake"), F.sum("payout").alias("payout"))


@query("d26_placebo")
def d26(spark, sf):
    """Probabilities shuffled inside the group for 20 seeds at once; the return should collapse."""
    df = model(spark, sf).select(*KEY, "p_model", "y", F.when(F.col("y") == 1, F.col("qty") * 20).otherwise(0).alias("pay"))
    # Shuffled once by group; the 20 seeds are fanned out behind the exchange.
    df = deal(df.repartition("group_id"), "group_id", factor=4)
    mixed = D.shuffled_within_all(df, "group_id", ["line", "entity", "person_a"], "p_model", list(range(20)))
    best = top_k(mixed.filter("p_model IS NOT NULL"), ["group_id", "seed"], -F.col("p_model"), 1, TIES)
    per = best.groupBy("seed").agg((F.sum("pay") / (F.count(F.lit(1)) * 100)).alias("roi"))
    return per.agg(F.round(F.avg("roi"), 6).alias("roi_mean"), F.round(F.stddev_samp("roi"), 6).alias("roi_std"),
                   F.round(F.percentile("roi", F.lit(0.05)), 6).alias("roi_p5"), F.round(F.percentile("roi", F.lit(0.95)), 6).alias("roi_p95"))


def _place(salt):
    return f"row_number() OVER (PARTITION BY seed ORDER BY substr(md5(concat_ws(':', seed || ':{salt}', {', '.join(f'CAST({k} AS VARCHAR)' for k in KEY)})), 1, 13), {K})"


@query("d26_global_placebo", msql(f"""SELECT seed, round(sum(pay) / (count(*) * 100), 6) AS roi, count(*) AS bets FROM (
 SELECT seed, pay, row_number() OVER (PARTITION BY seed, group_id ORDER BY p DESC, {', '.join(TIES)}) AS r FROM (
  SELECT t.*, g.p_model AS p FROM (SELECT *, {_place('to')} AS i FROM fan) t JOIN (SELECT seed, p_model, {_place('from')} AS i FROM fan) g ON t.seed = g.seed AND t.i = g.i)) WHERE r = 1 GROUP BY seed""",
 "fan AS (SELECT *, CASE WHEN y = 1 THEN qty * 20 ELSE 0 END AS pay FROM model, (SELECT CAST(range AS INTEGER) AS seed FROM range(0, 5)))"))
def d26g(spark, sf):
    """Probabilities shuffled over all rows, for five seeds: what the best of each group returns by chance."""
    df = model(spark, sf).select(*KEY, "p_model", F.when(F.col("y") == 1, F.col("qty") * 20).otherwise(0).alias("pay"))

    def returned(mixed):
        best = top_k(mixed.filter("p_model IS NOT NULL"), ["group_id", "seed"], -F.col("p_model"), 1, TIES)
        return best.groupBy("seed").agg(F.round(F.sum("pay") / (F.count(F.lit(1)) * 100), 6).alias("roi"), F.count(F.lit(1)).alias("bets"))

    return D.shuffled_globally(df, KEY, "p_model", list(range(5)), returned)


@query("d27_score_blend", msql(f"SELECT {K}, round(0.7 * p_model + 0.3 * p_market, 6) AS score FROM model"))
def d27(spark, sf):
    df = model(spark, sf)
    a, b = df.select(*KEY, "p_model"), df.select(*KEY, "p_market")
    return _pick(a.join(b, KEY), score=F.round(0.7 * F.col("p_model") + 0.3 * F.col("p_market"), 6))


@query("d28_residual_table", msql("SELECT CAST(floor(p_model * 5) AS BIGINT) AS bin, count(*) AS n, round(avg(p_model - y), 6) AS residual FROM model GROUP BY 1"))
def d28(spark, sf):
    return model(spark, sf).groupBy(F.floor(F.col("p_model") * 5).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("p_model") - F.col("y")), 6).alias("residual"))


@query("d29_greedy_fill", ssql(f"""
SELECT {K}, stake FROM (SELECT *, CAST(floor(least(want, greatest(0, 1500 - paid)) / 100) * 100 AS BIGINT) AS stake FROM (
 SELECT *, CAST(coalesce(sum(want) OVER (PARTITION BY group_id ORDER BY p DESC, line, entity, person_a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS paid FROM (
  SELECT *, CASE WHEN sc >= 100 THEN CAST(floor(least(sc, 800.0) / 100) * 100 AS BIGINT) ELSE 0 END AS want FROM (SELECT *, raw * least(1.0, 1500.0 / sum(raw) OVER (PARTITION BY group_id)) AS sc FROM (SELECT *, qty * 30 AS raw FROM evs))))) WHERE stake >= 100"""))
def d29(spark, sf):
    df = scored(spark, sf).withColumn("raw", F.col("qty") * 30)
    return D.greedy_fill(df, "group_id", "p", "raw", 1500, 800, ties=TIES).select(*KEY, "stake")


@query("d30_best_by_ev", ssql(f"""
SELECT {K}, pick FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY v DESC, line, entity, person_a) AS pick FROM (
 SELECT *, CASE WHEN have > 0 THEN p * o - 1 ELSE p - 0.275 END AS v FROM (SELECT *, count(o) OVER (PARTITION BY group_id) AS have FROM (SELECT *, CASE WHEN group_id % 4 <> 0 THEN odds END AS o FROM evs)))
 WHERE v > -0.5 AND (have = 0 OR o BETWEEN 1.2 AND 50)) WHERE pick <= 3"""))
def d30(spark, sf):
    df = scored(spark, sf).drop("ev").withColumn("o", F.when(F.col("group_id") % 4 != 0, F.col("odds")))
    return D.best_by_ev(df, "group_id", "p", "o", 3, 1.2, 50.0, -0.5, ties=TIES).select(*KEY, "pick")


@query("d31_wheel_tickets", ssql("SELECT a.group_id, a.line AS axis, b.line AS partner FROM scored a JOIN scored b ON a.group_id = b.group_id WHERE a.r = 1 AND b.r BETWEEN 2 AND 4 AND a.group_id IN (SELECT group_id FROM scored WHERE r = 4)"))
def d31(spark, sf):
    df = totals(scored(spark, sf), "group_id", size=F.count(F.lit(1))).filter("size >= 4")
    return P.wheel(df, "group_id", "line", "r", 3)


@query("d32_reranking", ssql(f"""
SELECT {K}, row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN r <= 2 THEN 0 WHEN r <= 6 THEN 1 ELSE 2 END, CASE WHEN r BETWEEN 3 AND 6 THEN -ev ELSE r END, r) AS fixed2,
 row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN r <= 5 THEN 0 ELSE 1 END, CASE WHEN r <= 5 THEN -ev ELSE r END, r) AS top5_by_ev,
 row_number() OVER (PARTITION BY group_id ORDER BY round(0.7 * coalesce((p - mnp) / nullif(mxp - mnp, 0), 0.5) + 0.3 * coalesce((ev - mne) / nullif(mxe - mne, 0), 0.5), 9) DESC, r) AS weighted
FROM (SELECT *, min(p) OVER g AS mnp, max(p) OVER g AS mxp, min(ev) OVER g AS mne, max(ev) OVER g AS mxe FROM evs WINDOW g AS (PARTITION BY group_id))"""))
def d32(spark, sf):
    df = scored(spark, sf)
    r, ev = F.col("r"), F.col("ev")
    part = lambda keep, cond: F.struct(keep, F.when(cond, -ev).otherwise(r.cast("double")), r)
    df = totals(df, "group_id", mnp=F.min("p"), mxp=F.max("p"), mne=F.min("ev"), mxe=F.max("ev"))
    norm = lambda c, a, b: F.coalesce(F.try_divide(F.col(c) - F.col(a), F.nullif(F.col(b) - F.col(a), F.lit(0.0))), F.lit(0.5))
    score = F.round(0.7 * norm("p", "mnp", "mxp") + 0.3 * norm("ev", "mne", "mxe"), 9)
    df = rank(df, "group_id", "weighted", -score, "first", ["r"])
    # Bands are whole numbers well apart, so band and inner order fit one sortable number.
    inner3 = F.when(r <= 2, r - 1e9).when(r <= 6, -ev).otherwise(r + 1e9)
    inner5 = F.when(r <= 5, -ev).otherwise(r + 1e9)
    df = rank(df, "group_id", "fixed2", inner3, "first", ["r"])
    df = rank(df, "group_id", "top5_by_ev", inner5, "first", ["r"])
    return df.select(*KEY, "fixed2", "top5_by_ev", "weighted")


@query("d33_flat_or_weighted_stake", ssql(f"SELECT {K}, CAST(greatest(100, round_even(ev, 0) * 100) AS BIGINT) AS stake FROM evs"))
def d33(spark, sf):
    return _pick(scored(spark, sf), stake=F.greatest(F.lit(100), (F.bround("ev", 0) * 100).cast("long")).cast("long"))
