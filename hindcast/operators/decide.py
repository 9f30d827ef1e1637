"""From probabilities and prices to stakes, tickets, settlement and ledgers."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import lookup, unit_floor
from ..plans.hot import cut_lineage, hot_keys, hot_row_limit, tag_hot
from .calendar import attach
from .history import history, past, seq
from .relative import rank, totals

# Share of the pool paid back per ticket type.
RETURN_RATES = {
    "win": 0.80, "place": 0.80, "wakuren": 0.775, "umaren": 0.775, "wide": 0.775,
    "umatan": 0.75, "sanrenpuku": 0.75, "sanrentan": 0.725,
}
#: Expected-value offset used where a group has no prices at all.
NO_PRICE_OFFSET = 0.275


def expected_value(p, price) -> Column:
    return F.col(p) * F.col(price)


def synthetic_price(p, ticket_type) -> Column:
    """Return rate over probability."""
    return F.try_divide(lookup(ticket_type, RETURN_RATES, 0.75), F.nullif(F.col(p), F.lit(0.0)))


def kelly(p, price) -> Column:
    """(p*price - 1) / (price - 1), never negative; 0 for prices of at most 1."""
    p, o = F.col(p), F.col(price)
    return F.when(o > 1, F.greatest(F.lit(0.0), (p * o - 1) / (o - 1))).otherwise(F.lit(0.0))


def kelly_stake(p, price, bankroll: float, fraction: float = 0.1, cap: float = 0.05, unit: int = 100) -> Column:
    return unit_floor(F.lit(float(bankroll)) * F.least(F.lit(cap), kelly(p, price) * fraction), unit)


def portfolio(
    df: DataFrame, group: str, kind: str, price: str, ev: str, thresholds: dict, default_threshold: float = 1.0,
    fraction: float = 0.1, base: float = 100_000.0, budget: float = 10_000.0, unit: int = 100,
) -> DataFrame:
    """EV threshold per ticket type, fractional Kelly, whole units, and a proportional
    cut of each group's stakes to its budget."""
    df = df.filter(F.col(ev) >= lookup(kind, thresholds, default_threshold))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(ev) - 1.0) / F.greatest(F.lit(0.1), F.col(price) - 1.0)))
    df = df.withColumn("amount", unit_floor(F.lit(float(base)) * (share * fraction), unit)).filter(F.col("amount") >= unit)
    df = totals(df, group, __sum=F.sum("amount"))
    cut = unit_floor(F.col("amount") * (F.lit(float(budget)) / F.col("__sum")), unit)
    df = df.withColumn("amount", F.when(F.col("__sum") > budget, cut).otherwise(F.col("amount")))
    return df.filter(F.col("amount") >= unit).drop("__sum")


def trim_to_budget(df: DataFrame, group: str, amount: str, ev: str, budget: int, unit: int = 100, ties=()) -> DataFrame:
    """Take whole units away from the lowest-EV rows until the group fits its budget.

    The number of units to remove is known up front; a row loses what is left of
    it after all rows with lower EV are used up.
    """
    df = totals(df, group, __sum=F.sum(amount))
    over = F.greatest(F.lit(0), F.col("__sum") - budget)
    df = df.withColumn("__cut", (F.ceil(over / unit) * unit).cast("long"))
    df = history(df, group, [ev, *ties], __gone=past("sum", amount, default=0))
    take = F.greatest(F.lit(0), F.least(F.col(amount), F.col("__cut") - F.col("__gone")))
    return df.withColumn(amount, F.col(amount) - take).filter(F.col(amount) > 0).drop("__sum", "__cut", "__gone")


def equal_split(df: DataFrame, group: str, ev: str, budget: int, cap: int, threshold: float = 0.0, unit: int = 100, ties=()) -> DataFrame:
    """The same stake for every row over the threshold; when that is below a unit, one
    unit for as many of the best rows as the budget pays."""
    df = totals(df.filter(F.col(ev) > threshold), group, __n=F.count(F.lit(1)))
    df = rank(df, group, "__r", -F.col(ev), "first", ties)
    per = F.least(unit_floor(F.lit(budget) / F.col("__n"), unit), F.lit(cap))
    df = df.filter((per >= unit) | (F.col("__r") <= budget // unit))
    return df.withColumn("amount", F.greatest(per, F.lit(unit)).cast("long")).drop("__n", "__r")


def greedy_fill(df: DataFrame, group: str, score: str, raw: str, budget: int, cap: int, unit: int = 100, ties=()) -> DataFrame:
    """Scale the raw stakes to the budget, cap and floor them, then pay in score order;
    the row that crosses the budget gets what is left, rounded down to a unit."""
    df = totals(df, group, __sum=F.sum(raw))
    scaled = F.col(raw) * F.least(F.lit(1.0), F.lit(float(budget)) / F.col("__sum"))
    df = df.withColumn("__want", F.when(scaled >= unit, unit_floor(F.least(scaled, F.lit(float(cap))), unit)).otherwise(F.lit(0)))
    df = df.withColumn("__neg", -F.col(score))
    df = history(df, group, ["__neg", *ties], __paid=past("sum", "__want", default=0))
    left = F.greatest(F.lit(0), F.lit(budget) - F.col("__paid"))
    df = df.withColumn("stake", unit_floor(F.least(F.col("__want"), left), unit))
    return df.filter(F.col("stake") >= unit).drop("__sum", "__want", "__neg", "__paid")


def best_by_ev(df: DataFrame, group: str, p: str, price: str, k: int, lo: float, hi: float, threshold: float, ties=()) -> DataFrame:
    """The k best rows by EV inside the price band; a group without any price is judged
    by p - offset and has no band."""
    df = totals(df, group, __priced=F.count(price))
    some = F.col("__priced") > 0
    df = df.withColumn("ev", F.when(some, F.col(p) * F.col(price) - 1).otherwise(F.col(p) - NO_PRICE_OFFSET))
    ok = (F.col("ev") > threshold) & (~some | F.col(price).between(lo, hi))
    df = rank(df.filter(ok), group, "pick", -F.col("ev"), "first", ties)
    return df.filter(F.col("pick") <= k).drop("__priced")


def cascade(df: DataFrame, rules: list[tuple[str, Column, int]]) -> DataFrame:
    """First matching rule per row: its name and amount."""
    name, amount = F.lit(None).cast("string"), F.lit(0)
    for label, when, cost in reversed(rules):
        name = F.when(when, F.lit(label)).otherwise(name)
        amount = F.when(when, F.lit(cost)).otherwise(amount)
    return df.withColumn("strategy", name).withColumn("amount", amount)


def day_cap(df: DataFrame, day: str, order: list[str], amount: str, cap: int, race: str | None = None, race_cap: int | None = None) -> DataFrame:
    """Buys the proposals of a day in order as long as each fits what is left of the day's
    cap and of its race's cap; what does not fit is skipped and the next one is tried.

    Rows without an amount are no proposals (bought = 0).  What is left only shrinks, so of
    the proposals of one amount only the first cap / amount can ever be bought: only these
    are folded, at most cap / least amount of each amount and day.  With a race cap the same
    holds inside the race, and ``order`` begins with the race.
    """
    scope = [day] if race is None else [day, race]
    limit = cap if race_cap is None else min(cap, race_cap)
    out = history(df, [*scope, amount], order, __nth=seq())
    can = F.coalesce((F.col(amount) > 0) & ((F.col("__nth") + 1) * F.col(amount) <= limit), F.lit(False))
    out = out.withColumn("__can", can)
    columns = df.columns
    row = F.struct(*[F.col(o) for o in order], F.col(amount).cast("long").alias("__a"), F.struct(*columns).alias("__row"))
    some = out.filter("__can").groupBy(day).agg(F.sort_array(F.collect_list(row)).alias("__all"))
    zero = F.lit(0).cast("long")

    def step(s, r):
        name = r["__row"][race].cast("string") if race is not None else F.lit("")
        there = F.when(s["race"].eqNullSafe(name), s["there"]).otherwise(zero)
        ok = (s["spent"] + r["__a"] <= cap) & (there + r["__a"] <= limit)
        cost = F.when(ok, r["__a"]).otherwise(zero)
        # Places of what is bought, at most cap / least amount of them: a step does not copy what came before it.
        bought = F.when(ok, F.array_append(s["ok"], s["i"])).otherwise(s["ok"])
        return F.struct((s["spent"] + cost).alias("spent"), name.alias("race"), (there + cost).alias("there"), bought.alias("ok"), (s["i"] + 1).alias("i"))

    start = F.struct(zero.alias("spent"), F.lit(None).cast("string").alias("race"), zero.alias("there"), F.array().cast("array<int>").alias("ok"), F.lit(0).alias("i"))
    some = some.withColumn("__ok", F.aggregate("__all", start, step)["ok"])
    some = some.select("__ok", F.posexplode("__all").alias("__at", "__z"))
    some = some.select("__z.__row.*", F.array_contains("__ok", F.col("__at")).cast("int").alias("bought"))
    return out.filter(~F.col("__can")).select(*columns, F.lit(0).alias("bought")).unionByName(some)


def settle(tickets: DataFrame, payouts: DataFrame, keys: list[str]) -> DataFrame:
    """Join the paid combinations; several payouts of one combination add up."""
    paid = payouts.groupBy(*keys).agg(F.sum("payout").alias("unit"))
    out = tickets.join(paid, keys, "left")
    value = F.coalesce(F.floor(F.col("stake") / 100.0 * F.col("unit")).cast("long"), F.lit(0))
    return out.withColumn("payout", value).withColumn("is_hit", F.col("unit").isNotNull().cast("int")).drop("unit")


def summary(df: DataFrame, stake: str, payout: str, by: list[str] = ()) -> DataFrame:
    s, p = F.sum(stake), F.sum(payout)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("bets"), s.alias("stake"), p.alias("payout"), (p - s).alias("profit"),
        (p / F.nullif(s, F.lit(0))).alias("roi"), F.avg((F.col(payout) > 0).cast("int").cast("double")).alias("hit_rate"),
    )


def equity(df: DataFrame, keys, order, profit: str, bankroll: float, stop: bool = True) -> DataFrame:
    """Running bankroll; with ``stop`` it is 0 from the first time it would reach 0.

    Ruin is a property of the running sum alone, so no step depends on an earlier
    decision: the account is ruined once the running minimum is <= 0.
    """
    out = history(df, keys, order, __b=past("sum", profit, default=0))
    out = out.withColumn("__raw", F.lit(bankroll) + F.col("__b") + F.col(profit))
    out = history(out, keys, order, __low=past("min", "__raw"))
    ruined = F.least(F.col("__low"), F.col("__raw")) <= 0
    out = out.withColumn("equity", F.when(ruined, F.lit(0.0)).otherwise(F.col("__raw")) if stop else F.col("__raw"))
    out = history(out, keys, order, __high=past("max", "equity"))
    peak = F.greatest(F.lit(float(bankroll)), F.col("__high"), F.col("equity"))
    dd = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (peak - F.col("equity")) / peak))
    return out.withColumn("drawdown", dd).drop("__b", "__raw", "__low", "__high")


def _at_most(score: Column):
    return lambda threshold: threshold <= score


def sweep(df: DataFrame, axes: dict[str, tuple[Column, list[float]]], stake: Column, payout: Column, variants: dict[str, list] | None = None, by: list[str] = ()) -> DataFrame:
    """Every setting against all rows that pass it, as dominance sums.

    ``axes``: name -> (score, thresholds); a row passes a setting where no score is below its threshold.  ``variants``:
    further values that scores, stake and payout may use as columns.  A row counts once for each variant, at the last
    threshold that it passes on every axis; what a setting holds is the sum of the cells at or beyond it.  Cells are at
    most one for each setting and ``by``, so nothing but the first aggregation sees the rows.
    """
    variants, names = variants or {}, list(axes)
    for name, values in variants.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    levels = {name: sorted(set(values)) for name, (_, values) in axes.items()}
    for name, (score, _) in axes.items():
        passed = F.size(F.filter(F.array(*[F.lit(float(t)) for t in levels[name]]), _at_most(score)))
        df = df.withColumn(f"__{name}", passed)
    keys = [*variants, *by]
    cells = df.filter(" AND ".join(f"__{name} > 0" for name in names)).groupBy(*keys, *[f"__{name}" for name in names])
    cells = cells.agg(F.count(F.lit(1)).alias("bets"), F.sum(stake).alias("stake"), F.sum(payout).alias("payout"))
    for name in names:  # the settings that the rows of a cell pass
        cells = cells.withColumn(name, F.explode(F.slice(F.array(*[F.lit(float(t)) for t in levels[name]]), F.lit(1), F.col(f"__{name}"))))
    s, p = F.sum("stake"), F.sum("payout")
    return cells.groupBy(*names, *keys).agg(F.sum("bets").alias("bets"), s.alias("stake"), p.alias("payout"), (p / F.nullif(s, F.lit(0))).alias("roi"))


def uniform_hash(seed: Column, *key: Column) -> Column:
    """A whole number below 2^52 that depends on the seed and the key alone (the first digits of an md5, the same in SQL)."""
    text = F.concat_ws(":", seed.cast("string"), *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


#: Places of one block of a shuffle over all rows, and cells of the hash for each block.
PLACES = 250_000
CELLS = 64


def shuffled_globally(df: DataFrame, key: list[str], col: str, seeds: list[int], each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``col`` permuted over all rows, once for each seed (column ``seed``): the row that comes i-th by one seeded hash of its
    key receives the value of the row that comes i-th by another.  ``key`` is a total order of the rows.

    Blocks of places meet: counts of equal stretches (cells) of either hash tell which places a cell takes, so a row travels
    once for each side, to the block of its places; a cell across the end of a block goes to both.  Inside a block places are
    row numbers of the cells.  No task holds a seed's rows.  Seeds follow each other, and what travelled for one is freed
    before the next.  ``each`` is applied to the rows of a seed; only what it makes of them is kept.
    """
    rest = [c for c in df.columns if c != col]
    df = cut_lineage(df)  # counted, then read for either side
    blocks = max(1, math.ceil(df.count() / PLACES))
    each = each or (lambda rows: rows)
    parts = [cut_lineage(each(_placed(df, key, col, rest, seed, blocks))) for seed in seeds]
    return reduce(lambda x, y: x.unionByName(y), parts)


def _placed(df: DataFrame, key: list[str], col: str, rest: list[str], seed: int, blocks: int) -> DataFrame:
    fan = df.select("*", F.lit(seed).alias("seed"))
    names = [F.col(k) for k in key]
    hashed = lambda salt: uniform_hash(F.concat_ws(":", F.col("seed"), F.lit(salt)), *names).alias("__h")
    void = lambda c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    takes = fan.select("seed", F.lit(0).alias("__gives"), hashed("to"), *rest, void(col))
    gives = fan.select("seed", F.lit(1).alias("__gives"), hashed("from"), *[F.col(c) if c in key else void(c) for c in rest], col)
    offers = takes.unionByName(gives).withColumn("__cell", F.floor(F.col("__h") / math.ceil(2**52 / (blocks * CELLS))))
    side = ["seed", "__gives"]
    before = Window.partitionBy(*side).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = offers.groupBy(*side, "__cell").agg(F.count(F.lit(1)).alias("__n")).withColumn("__at", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    reach = F.sequence(F.floor(F.col("__at") / PLACES), F.floor((F.col("__at") + F.col("__n") - 1) / PLACES))
    cells = cut_lineage(cells.select(*side, "__cell", "__at", reach.alias("__blocks")))  # CELLS a block, side and seed
    dealt = offers.join(F.broadcast(cells), [*side, "__cell"]).withColumn("__block", F.explode("__blocks")).drop("__blocks")
    dealt = dealt.repartition(blocks, "seed", "__block")
    inside = Window.partitionBy("seed", "__block", "__gives", "__cell").orderBy("__h", *key)
    placed = dealt.withColumn("__i", F.col("__at") + F.row_number().over(inside) - 1).filter(F.floor(F.col("__i") / PLACES) == F.col("__block"))
    place = Window.partitionBy("seed", "__block", "__i")
    return placed.withColumn(col, F.max(col).over(place)).filter("__gives = 0").select("seed", *rest, col)


#: Rows of a group that are shuffled in one array, once for each seed.
ARRAY_ROWS = 10_000


def shuffled_within_all(df: DataFrame, group, key: list[str], col: str, seeds: list[int]) -> DataFrame:
    """``shuffled_within`` once for each seed (column ``seed``).  The rows of a group stand in one array, sorted by key; each
    seed sorts the values there, so copies are neither moved nor counted.  Groups of more than ARRAY_ROWS rows take windows."""
    groups = [group] if isinstance(group, str) else list(group)
    rest = [c for c in df.columns if c not in groups and c != col]
    names = [*groups, "seed", *rest, col]
    fan = F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")
    found, large = hot_keys(df, groups, min(hot_row_limit(df), ARRAY_ROWS)), None
    if found is not None:
        df, large = tag_hot(df, found)
    row = F.struct(F.xxhash64(*key).alias("__h"), *[F.col(k) for k in key], F.struct(*rest).alias("__row"), F.col(col).alias("__v"))
    out = df.groupBy(*groups).agg(F.array_sort(F.collect_list(row)).alias("__rows")).select(*groups, "__rows", fan)
    mine = lambda x: F.struct(F.xxhash64(*[x[k] for k in key], F.col("seed")).alias("__h"), *[x[k].alias(k) for k in key], x["__v"].alias("__v"))
    given = F.array_sort(F.transform("__rows", mine))
    pair = lambda x, y: F.struct(x["__row"].alias("row"), y["__v"].alias("v"))
    out = out.select(*groups, "seed", F.explode(F.zip_with("__rows", given, pair)).alias("__o"))
    out = out.select(*groups, "seed", "__o.row.*", F.col("__o.v").alias(col)).select(*names)
    if large is None:
        return out
    return out.unionByName(shuffled_within(large.select("*", fan), [*groups, "seed"], key, col, F.col("seed")).select(*names))


def shuffled_within(df: DataFrame, group: str, key: list[str], col: str, seed: Column) -> DataFrame:
    """``col`` permuted inside each group: the i-th row by key receives the value of the
    i-th row by a seeded hash.  ``group`` may include the seed to run many at once."""
    groups = [group] if isinstance(group, str) else list(group)
    rest = [c for c in df.columns if c not in groups and c != col]
    df = rank(df, groups, "__i", F.xxhash64(*key), "first", key)
    df = rank(df, groups, "__j", F.xxhash64(*key, seed), "first", key)
    # Each row offers its place (i) and its value (j); equal numbers meet in one window,
    # which keeps the partitioning by group: no join.
    body = F.struct(*rest)
    offers = F.array(
        F.struct(F.col("__i").alias("n"), body.alias("row"), F.lit(None).cast(df.schema[col].dataType).alias("v")),
        F.struct(F.col("__j").alias("n"), F.lit(None).cast(df.select(body.alias("b")).schema["b"].dataType).alias("row"), F.col(col).alias("v")),
    )
    df = df.select(*groups, F.explode(offers).alias("o"))
    w = Window.partitionBy(*groups, "o.n")
    df = df.select(*groups, "o.row", F.max("o.v").over(w).alias(col))
    return df.filter("row IS NOT NULL").select(*groups, "row.*", col)
