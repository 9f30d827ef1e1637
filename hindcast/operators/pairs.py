"""Combinations inside a group and the probabilities of ordered finishes.

Combination tables are equi-joins on the group key; their output is the result
itself (one row per ticket).  Groups too big for one task are dealt over salts.
Sums over partners that need no ticket rows use closed forms instead of pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.hot import hot_keys, hot_row_limit, salted_self_pairs, tag_hot
from .history import history, past
from .relative import totals


def _side(df: DataFrame, keys: list[str], columns: list[str], tag: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{c}_{tag}") for c in columns])


def pairs(df: DataFrame, group, key: str, columns: list[str], how: str = "ordered") -> DataFrame:
    """Pairs (1,2) of rows of one group: ``ordered`` i!=j, ``unordered`` i<j, ``repeated`` i<=j."""
    group = [group] if isinstance(group, str) else list(group)
    cols = [key, *[c for c in columns if c != key]]
    base = df.select(*group, *cols)
    left, right, on = salted_self_pairs(base, group, hot_keys(base, group))
    a, b = F.col(f"{key}_1"), F.col(f"{key}_2")
    cond = {"ordered": a != b, "unordered": a < b, "repeated": a <= b}[how]
    out = _side(left, on, cols, "1").join(_side(right, on, cols, "2"), on).filter(cond)
    return out.drop("__salt")


#: Rows of a group, or of a block of one, that a task combines three at a time.
TRIPLE_ROWS = 200


def triples(df: DataFrame, group, key: str, columns: list[str], how: str = "ordered") -> DataFrame:
    """Triples of distinct rows, ``ordered`` or ``unordered`` (i<j<k).

    A three-way block join: a group of more than TRIPLE_ROWS rows is cut into b blocks by a hash, and every triple of
    blocks is a key of its own, to which each side sends the rows of one block.  All three sides are dealt once, on one
    key; what the first join makes stays where it is.
    """
    group = [group] if isinstance(group, str) else list(group)
    cols = [key, *[c for c in columns if c != key]]
    base = df.select(*group, *cols)
    hot = hot_keys(base, group, min(hot_row_limit(df), TRIPLE_ROWS))
    if hot is None:
        sides, on = [base] * 3, group
    else:
        blocks = hot.table.select(*group, F.pow(F.lit(2), F.col("__class") + 1).cast("int").alias("__b"))
        cold, heavy = tag_hot(base, hot, blocks)
        own = F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.col("__b"))
        every = F.sequence(F.lit(0).cast("long"), F.col("__b").cast("long") - 1)
        none = F.lit(0).cast("long")
        on, sides = [*group, "__x", "__y", "__z"], []
        for mine in ("__x", "__y", "__z"):
            spread = heavy.withColumn("__own", own.cast("long"))
            for place in ("__x", "__y", "__z"):
                spread = spread.withColumn(place, F.col("__own") if place == mine else F.explode(every))
            plain = cold.select("*", *[none.alias(place) for place in ("__x", "__y", "__z")])
            sides.append(plain.unionByName(spread.select(*plain.columns)))
    one, two, three = (_side(side, on, cols, str(i)) for i, side in enumerate(sides, 1))
    a, b, c = (F.col(f"{key}_{i}") for i in (1, 2, 3))
    out = one.join(two, on).filter(a != b if how == "ordered" else a < b)
    out = out.join(three, on).filter((c != a) & (c != b) if how == "ordered" else b < c)
    return out.drop("__x", "__y", "__z")


# --- finish probabilities from win probabilities ------------------------------


def exacta(p1: Column, p2: Column) -> Column:
    """P(1 first, 2 second)."""
    return F.when(p1 < 1, p1 * p2 / (1 - p1)).otherwise(F.lit(0.0))


def quinella(p1: Column, p2: Column) -> Column:
    return exacta(p1, p2) + exacta(p2, p1)


def trifecta(p1: Column, p2: Column, p3: Column) -> Column:
    """P(1 first, 2 second, 3 third)."""
    left = 1 - p1 - p2
    return F.when((p1 < 1) & (left > 1e-12), p1 * p2 / (1 - p1) * p3 / left).otherwise(F.lit(0.0))


def trio(p1: Column, p2: Column, p3: Column) -> Column:
    perms = [(p1, p2, p3), (p1, p3, p2), (p2, p1, p3), (p2, p3, p1), (p3, p1, p2), (p3, p2, p1)]
    out = F.lit(0.0)
    for x in perms:
        out = out + trifecta(*x)
    return out


def second_place(df: DataFrame, group, p: str, name: str) -> DataFrame:
    """P(row is second) = p * (S - p/(1-p)) with S the group sum of p/(1-p): no pairs needed."""
    odd = F.when(F.col(p) < 1, F.col(p) / (1 - F.col(p))).otherwise(F.lit(0.0))
    out = totals(df.withColumn("__odd", odd), group, __S=F.sum("__odd"))
    return out.withColumn(name, F.col(p) * (F.col("__S") - F.col("__odd"))).drop("__odd", "__S")


def third_place(df: DataFrame, group, key: str, p: str) -> DataFrame:
    """One row per (group, key) with ``p_third``.

    P(i third) = p_i * sum over unordered pairs {j,k} without i of c_jk, where
    c_jk = quinella(p_j, p_k) / (1 - p_j - p_k).  Summing c over the pairs of the
    group and over the pairs containing i leaves unordered pairs, not triples.
    """
    group = [group] if isinstance(group, str) else list(group)
    two = pairs(df, group, key, [p], "unordered")
    rest = 1 - F.col(f"{p}_1") - F.col(f"{p}_2")
    two = two.withColumn("__c", F.when(rest > 1e-12, quinella(F.col(f"{p}_1"), F.col(f"{p}_2")) / rest).otherwise(F.lit(0.0)))
    ends = two.select(*group, F.explode(F.array(F.col(f"{key}_1"), F.col(f"{key}_2"))).alias(key), "__c")
    mine = ends.groupBy(*group, key).agg(F.sum("__c").alias("__mine"))
    out = df.select(*group, key, p).join(mine, [*group, key], "left")
    out = totals(out, group, __all=F.sum("__mine"))
    value = F.col(p) * (F.col("__all") / 2 - F.col("__mine"))
    return out.select(*group, key, p, F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)).alias("p_third"))


def both_in_top3(df: DataFrame, group, key: str, p: str) -> DataFrame:
    """P(both rows of the pair finish in the first three), one row per unordered pair.

    The pair is first-second, or one of it is third behind a pair {other, k}:
    every unordered triple containing both, so each triple's trio probability is
    added to its three pairs.
    """
    group = [group] if isinstance(group, str) else list(group)
    t = triples(df, group, key, [p], "unordered")
    t = t.withColumn("__t", trio(*[F.col(f"{p}_{i}") for i in (1, 2, 3)]))
    a, b, c = (F.col(f"{key}_{i}") for i in (1, 2, 3))
    duo = lambda x, y: F.struct(x.alias("key_1"), y.alias("key_2"))
    t = t.select(*group, F.explode(F.array(duo(a, b), duo(a, c), duo(b, c))).alias("d"), "__t")
    return t.groupBy(*group, "d").agg(F.sum("__t").alias("p")).select(*group, "d.*", "p")


def head_to_head(df: DataFrame, group: str, day: str, entity: str, outcome: str) -> DataFrame:
    """Per row: earlier meetings with the other entities of its group and the share won.

    A meeting of two entities is one row (not one for each side), kept where the group is dealt to; the history of the
    pair gives meetings and wins of both.  Entries are dealt by group once, meetings by pair once, and what they add up
    to by group and entity once; the rows themselves follow by the same key.  Rows without an outcome take no part in
    past meetings.
    """
    entries = df.groupBy(group, day, entity).agg(F.min(outcome).alias("__o"))
    met = pairs(entries, [group, day], entity, ["__o"], "unordered")
    a, b = F.col("__o_1"), F.col("__o_2")
    known = a.isNotNull() & b.isNotNull()
    won = lambda c: F.coalesce((known & c).cast("int"), F.lit(0))
    met = met.select(group, day, F.col(f"{entity}_1").alias("__a"), F.col(f"{entity}_2").alias("__b"), known.cast("int").alias("__m"), won(a < b).alias("__w"), won(b < a).alias("__l"))
    met = history(met, ["__a", "__b"], [day, group], __pm=past("sum", "__m", default=0), __pw=past("sum", "__w", default=0), __pl=past("sum", "__l", default=0))
    ends = F.array(F.struct(F.col("__a").alias("e"), F.col("__pw").alias("w")), F.struct(F.col("__b").alias("e"), F.col("__pl").alias("w")))
    side = met.select(group, F.explode(ends).alias("x"), "__pm").filter("__pm > 0").select(group, F.col("x.e").alias(entity), "__pm", F.col("x.w").alias("__pw"))
    side = side.groupBy(group, entity).agg(F.sum("__pm").alias("vs_matches"), F.sum("__pw").alias("__wins"))
    out = df.join(side, [group, entity], "left")
    rate = F.coalesce(F.try_divide(F.col("__wins"), F.col("vs_matches")), F.lit(0.0))
    return out.withColumn("vs_win_rate", rate).withColumn("vs_matches", F.coalesce("vs_matches", F.lit(0))).drop("__wins")


def wheel(ranked: DataFrame, group: str, key: str, rank: str, partners: int) -> DataFrame:
    """The best row paired with each of the next ``partners`` rows."""
    axis = ranked.filter(F.col(rank) == 1).select(group, F.col(key).alias("axis"))
    rest = ranked.filter(F.col(rank).between(2, partners + 1)).select(group, F.col(key).alias("partner"))
    return axis.join(rest, group)


def formation(ranked: DataFrame, group: str, key: str, rank: str, legs: list[list[int]], ordered: bool) -> DataFrame:
    """Tickets taking one row per leg from the given rank lists, all rows distinct;
    unordered tickets are sorted and kept once."""
    out = None
    for i, ranks in enumerate(legs):
        leg = ranked.filter(F.col(rank).isin(ranks)).select(group, F.col(key).alias(f"k{i}"))
        out = leg if out is None else out.join(leg, group)
    ks = [F.col(f"k{i}") for i in range(len(legs))]
    ticket = F.array(*ks)
    out = out.filter(F.size(F.array_distinct(ticket)) == len(legs))
    if not ordered:
        ticket = F.array_sort(ticket)
    return out.select(group, ticket.alias("selection")).distinct()
