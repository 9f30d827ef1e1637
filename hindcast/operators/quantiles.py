"""Expanding order statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.hot import cut_lineage, hot_keys, hot_row_limit, match
from .history import history, own_keys, past, seq
from .ranks import expanding, expanding_hot, numbered_hot

FIRST = Window.unboundedPreceding


#: Values that are sorted at the end of an exact quantile (on the driver for whole columns).
LAST_VALUES = 200_000
#: Rows of one key that a Python task holds at most, whatever the session allows.
TASK_ROWS = 1_000_000


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]], last: int = LAST_VALUES) -> dict[str, float | None]:
    """Exact quantiles (linear interpolation, as ``percentile``) of whole columns: name -> (column, q).

    No buffer holds the distinct values: a quantile sketch brackets the wanted rank, one pass counts what lies below
    and inside, and the bracket shrinks until at most ``last`` rows, or a single value, are left.  All columns share
    the passes.  NULLs are left out; a column without values gives None.
    """
    if not wanted:
        return {}
    df = df.select(*[c.cast("double").alias(f"c{i}") for i, (c, _) in enumerate(wanted.values())])
    count = df.agg(*[f(f"c{i}").alias(f"{n}{i}") for i in range(len(wanted)) for n, f in (("n", F.count), ("a", F.min), ("b", F.max))]).first()
    open_, out = {}, {}
    for i, (name, (_, q)) in enumerate(wanted.items()):
        out[name] = None
        if count[f"n{i}"]:
            at = (count[f"n{i}"] - 1) * q
            open_[i] = {"name": name, "at": at, "lo": count[f"a{i}"], "hi": count[f"b{i}"], "below": 0, "inside": count[f"n{i}"]}
    while large := {i: s for i, s in open_.items() if s["inside"] > last and s["lo"] < s["hi"]}:
        inside = {i: F.when(F.col(f"c{i}").between(s["lo"], s["hi"]), F.col(f"c{i}")) for i, s in large.items()}
        points = {i: [max(0.0, (math.floor(s["at"]) - s["below"]) / s["inside"] - 1e-3), min(1.0, (math.ceil(s["at"]) - s["below"]) / s["inside"] + 1e-3)] for i, s in large.items()}
        near = df.agg(*[F.percentile_approx(inside[i], points[i], 10_000).alias(f"p{i}") for i in large]).first()
        cuts = {i: (near[f"p{i}"][0], near[f"p{i}"][1]) for i in large}
        seen = df.agg(*[x for i in large for x in (F.count_if(F.col(f"c{i}") < cuts[i][0]).alias(f"l{i}"), F.count_if(F.col(f"c{i}").between(*cuts[i])).alias(f"m{i}"))]).first()
        for i, s in large.items():
            low, mid = seen[f"l{i}"], seen[f"m{i}"]
            if low <= math.floor(s["at"]) and math.ceil(s["at"]) < low + mid and mid < s["inside"]:
                s.update(lo=cuts[i][0], hi=cuts[i][1], below=low, inside=mid)
            else:  # the sketch missed the rank, or one value fills the bracket: halve by value
                half = s["lo"] + (s["hi"] - s["lo"]) / 2
                c = df.agg(F.count_if(F.col(f"c{i}") <= half).alias("l"), F.max(F.when(F.col(f"c{i}") <= half, F.col(f"c{i}"))).alias("x"), F.min(F.when(F.col(f"c{i}") > half, F.col(f"c{i}"))).alias("y")).first()
                if math.ceil(s["at"]) < c["l"]:
                    s.update(hi=c["x"], inside=c["l"] - s["below"])
                elif math.floor(s["at"]) >= c["l"]:
                    s.update(inside=s["below"] + s["inside"] - c["l"], below=c["l"], lo=c["y"])
                else:  # the rank lies between two values
                    x, y = c["x"], c["y"]
                    s.update(done=(math.ceil(s["at"]) - s["at"]) * x + (s["at"] - math.floor(s["at"])) * y, inside=0)
    for i, s in open_.items():
        lo, hi = math.floor(s["at"]), math.ceil(s["at"])
        if "done" in s:
            out[s["name"]] = s["done"]
            continue
        if s["lo"] == s["hi"]:
            out[s["name"]] = s["lo"]
            continue
        rows = df.filter(F.col(f"c{i}").between(s["lo"], s["hi"])).groupBy(f"c{i}").count().orderBy(f"c{i}").collect()
        upto, value = s["below"], {}
        for r in rows:
            for rank in (lo, hi):
                if upto <= rank < upto + r["count"]:
                    value[rank] = r[f"c{i}"]
            upto += r["count"]
        out[s["name"]] = value[lo] if lo == hi else (hi - s["at"]) * value[lo] + (s["at"] - lo) * value[hi]
    return out


def group_quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]], last: int = LAST_VALUES) -> DataFrame:
    """Exact quantiles (linear interpolation, as ``percentile``) by group: ``by`` and one column for each of ``wanted``,
    name -> (column, q).  NULL keys are a group; NULL values are left out, a group without values gives NULL.

    No buffer holds the values of a group.  Groups of at most ``last`` values count their distinct values and sort them.
    A larger group has a bracket for each quantile, a row of a table: a sketch of the rows inside proposes a narrower
    one, a count confirms it (else it is halved by value), until at most ``last`` rows, or one value, are left.  There are
    at most rows/last such groups, whose brackets are broadcast; their rows are never brought together.
    """
    columns: list[Column] = []
    asks = []
    for name, (c, q) in wanted.items():
        same = next((i for i, x in enumerate(columns) if x._jc.equals(c._jc)), len(columns)) if hasattr(c, "_jc") else len(columns)
        if same == len(columns):
            columns.append(c)
        asks.append((name, same, float(q)))
    keys = [f"__k{i}" for i in range(len(by))]
    each = F.array(*[F.struct(F.lit(i).alias("i"), c.cast("double").alias("v")) for i, c in enumerate(columns)])
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.explode(each).alias("e")).select(*keys, "e.i", "e.v")
    cell = [*keys, "i"]
    stats = cut_lineage(rows.groupBy(*cell).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    rows = rows.filter("v IS NOT NULL")
    big = stats.filter(F.col("n") > last)
    ask = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("of"), F.lit(q).alias("q")) for j, (_, i, q) in enumerate(asks)])).alias("a")
    marks = big.select("*", ask).filter("a.of = i").select(*cell, "a.j", ((F.col("n") - 1) * F.col("a.q")).alias("at"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.lit(None).cast("double").alias("value"))
    marks = _narrowed(rows, cut_lineage(marks), cell, last)
    # what the brackets hold, and the groups that need none
    inside = _met(rows, marks.filter("value IS NULL"), cell).filter("v BETWEEN lo AND hi").select(*cell, "j", "at", "below", "v")
    small = rows.alias("l").join(F.broadcast(big.select(*cell).alias("r")), match(cell), "left_anti")
    sized = F.lit(None).cast("int").alias("j"), F.lit(None).cast("double").alias("at"), F.lit(0).cast("long").alias("below")
    cells = inside.unionByName(small.select(*cell, *sized, "v")).groupBy(*cell, "j", "at", "below", "v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*cell, "j").orderBy("v").rowsBetween(FIRST, 0)
    cells = cells.withColumn("upto", F.col("below") + F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*cell, "j")))
    parts = []
    for j, (name, i, q) in enumerate(asks):
        at = F.when(F.col("j").isNull(), (F.col("n") - 1) * F.lit(q)).otherwise(F.col("at"))
        mine = (F.col("i") == i) & (F.col("j").isNull() | (F.col("j") == j))
        for end, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = mine & (F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto"))
            parts.append(F.max(F.when(here, F.col("v"))).alias(f"{j}{end}"))
        parts.append(F.max(F.when(mine, at)).alias(f"{j}at"))
    found = cells.groupBy(*keys).agg(*parts)
    done = marks.groupBy(*keys).agg(*[F.max(F.when(F.col("j") == j, F.col("value"))).alias(f"{j}done") for j in range(len(asks))])
    out = stats.select(*keys).distinct().alias("l").join(found.alias("r"), match(keys), "left").select("l.*", *[F.col(f"r.{c}") for c in found.columns if c not in keys])
    out = out.alias("l").join(F.broadcast(done.alias("r")), match(keys), "left").select("l.*", *[F.col(f"r.{c}") for c in done.columns if c not in keys])

    def value(j: int) -> Column:
        at, low, high = F.col(f"{j}at"), F.col(f"{j}lo"), F.col(f"{j}hi")
        between = F.when(at == F.floor(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)
        return F.coalesce(F.col(f"{j}done"), between)

    return out.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], *[value(j).alias(name) for j, (name, _, _) in enumerate(asks)])


def _met(rows: DataFrame, marks: DataFrame, cell: list[str]) -> DataFrame:
    """Rows with the brackets of their group, of which there are few."""
    both = rows.alias("l").join(F.broadcast(marks.alias("r")), match(cell), "inner")
    return both.select(*[F.col(f"l.{c}") for c in cell], "l.v", *[F.col(f"r.{c}") for c in marks.columns if c not in cell])


#: Parts into which a round cuts a bracket.
STEPS = 64


def _narrowed(rows: DataFrame, marks: DataFrame, cell: list[str], last: int) -> DataFrame:
    """Brackets that hold at most ``last`` rows each, or whose ``value`` is known."""
    open_ = F.col("value").isNull() & (F.col("inside") > last) & (F.col("lo") < F.col("hi"))
    one = [*cell, "j"]
    while True:
        marks = cut_lineage(marks.withColumn("value", F.when(F.col("value").isNull() & (F.col("lo") == F.col("hi")), F.col("lo")).otherwise(F.col("value"))))
        wide = marks.filter(open_)
        if wide.isEmpty():
            return marks
        held = _met(rows, wide, cell).filter("v BETWEEN lo AND hi")
        points = held.groupBy(*one).agg(F.percentile_approx("v", [i / STEPS for i in range(STEPS + 1)], 10_000).alias("p"))
        points = points.alias("l").join(F.broadcast(wide.alias("r")), match(one), "inner").select("l.p", *[F.col(f"r.{c}") for c in wide.columns])
        part = lambda rank: (rank - F.col("below")) / F.col("inside") * STEPS
        a = F.greatest(F.lit(0), F.floor(part(F.floor("at"))) - 1).cast("int")
        b = F.least(F.lit(STEPS), F.ceil(part(F.ceil("at"))) + 1).cast("int")
        points = cut_lineage(points.withColumn("lo2", F.get("p", a)).withColumn("hi2", F.get("p", b)).withColumn("mid", F.col("lo") + (F.col("hi") - F.col("lo")) / 2).drop("p"))
        v = F.col("v")
        seen = _met(rows, points, cell).filter("v BETWEEN lo AND hi").groupBy(*one).agg(
            F.count_if(v < F.col("lo2")).alias("under"), F.count_if(v.between(F.col("lo2"), F.col("hi2"))).alias("among"),
            F.count_if(v <= F.col("mid")).alias("half"), F.max(F.when(v <= F.col("mid"), v)).alias("x"), F.min(F.when(v > F.col("mid"), v)).alias("y"))
        seen = points.alias("l").join(seen.alias("r"), match(one), "inner").select("l.*", *[F.col(f"r.{c}") for c in ("under", "among", "half", "x", "y")])
        low, high, at, below = F.floor("at"), F.ceil("at"), F.col("at"), F.col("below")
        good = (below + F.col("under") <= low) & (high < below + F.col("under") + F.col("among")) & (F.col("among") < F.col("inside"))
        left, right = high < below + F.col("half"), low >= below + F.col("half")
        pick = lambda g, l, r: F.when(good, g).when(left, l).when(right, r)
        new = seen.select(
            *one, "at", pick(F.col("lo2"), F.col("lo"), F.col("y")).alias("lo"), pick(F.col("hi2"), F.col("x"), F.col("hi")).alias("hi"),
            pick(below + F.col("under"), below, below + F.col("half")).alias("below"), pick(F.col("among"), F.col("half"), F.col("inside") - F.col("half")).alias("inside"),
            F.when(~good & ~left & ~right, (high - at) * F.col("x") + (at - low) * F.col("y")).alias("value"))  # the rank lies between two values
        marks = marks.filter(~open_).unionByName(new)


def expanding_quantile(df: DataFrame, keys, order, col, q: float, name: str, min_n: int = 1) -> DataFrame:
    """Quantile (linear interpolation) of all earlier values of the key; NULL with fewer than ``min_n``.

    Linear-logarithmic in the length of a history: the rows of a key are ranked together, not one frame after the other.
    A key with more rows than a task may hold is split by time and by value.
    """
    keys = own_keys(df, keys)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    limit = min(hot_row_limit(df), TASK_ROWS)
    hot = hot_keys(df, keys, limit)
    value = (F.col(col) if isinstance(col, str) else col).cast("double").alias("__v")
    if hot is None:
        return expanding(df.select("*", value), keys, order, q, min_n).withColumnRenamed("__v", name)
    cold, heavy = numbered_hot(cut_lineage(df.select("*", value)), hot)
    out = expanding(cold, keys, order, q, min_n).withColumnRenamed("__v", name)
    heavy = cut_lineage(history(heavy, "__h", order, __pos=seq(), __n=past("count", "__v", default=0)))
    found = expanding_hot(heavy.select("__h", "__pos", "__n", "__v"), q, min_n, limit, hot.biggest)
    heavy = heavy.join(found, ["__h", "__pos"]).withColumn(name, F.col("__value"))
    return out.unionByName(heavy.select(*out.columns))


def expanding_mode(df: DataFrame, keys, order, col: str, domain: list, name: str, default=None) -> DataFrame:
    """Most frequent earlier value out of a declared domain, the first listed on ties;
    ``default`` without history.  Counts per value make it splittable like any sum."""
    specs = {f"__m{i}": past("sum", (F.col(col) == F.lit(v)).cast("int"), default=0) for i, v in enumerate(domain)}
    out = history(df, keys, order, **specs)
    best = F.greatest(*[F.col(c) for c in specs])
    value = F.lit(default)
    for i, v in reversed(list(enumerate(domain))):
        value = F.when((best > 0) & (F.col(f"__m{i}") == best), F.lit(v)).otherwise(value)
    return out.withColumn(name, value).drop(*specs)
