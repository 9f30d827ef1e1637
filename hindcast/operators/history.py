"""Histories: what was known about a key before this row.

``history(df, keys, order, name=spec, ...)`` adds columns computed from the rows
of the same key that come strictly earlier in ``order``.  All specs of one call
share a single exchange and sort.  ``order`` is ascending; its first column must
be numeric, a date or a timestamp, and the whole list should be a total order.

Keys with too many rows for one task are cut into time segments.  Bounded frames
(lag, last k) see the preceding rows through copied halo rows, unbounded frames
through the combined partial aggregates of the earlier segments, so the result
does not depend on the cut.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..plans.hot import HotKeys, cut_lineage, hot_keys, hot_row_limit, tag_hot

FIRST = Window.unboundedPreceding
EPOCH = "1970-01-01"


@dataclass(frozen=True)
class Spec:
    kind: str
    agg: str = ""
    col: Column | None = None
    k: int = 0
    min_n: int = 1
    default: object = None
    q: float = 0.5


def _c(col) -> Column | None:
    return F.col(col) if isinstance(col, str) else col


def lag(col, k: int = 1, default=None) -> Spec:
    """k-th previous value; ``default`` replaces a missing one."""
    return Spec("lag", col=_c(col), k=k, default=default)


def seq() -> Spec:
    """Number of earlier rows."""
    return Spec("seq")


def past(agg: str, col="*", min_n: int = 1, default=None, q: float = 0.5) -> Spec:
    """sum | count | mean | min | max | std | first | last (non-NULL) | quantile over all earlier rows."""
    return Spec("past", agg, F.lit(1) if isinstance(col, str) and col == "*" else _c(col), min_n=min_n, default=default, q=q)


def last_k(agg: str, col, k: int, min_n: int = 1, default=None, q: float = 0.5) -> Spec:
    """Same aggregates plus ``quantile`` over the k rows before this one."""
    return Spec("last", agg, _c(col), k=k, min_n=min_n, default=default, q=q)


def ewm(col, alpha: float) -> Spec:
    """Exponentially weighted mean of all earlier values, weights renormalised
    (adjust=True) and counted by row position, so a gap still ages the values."""
    return Spec("ewm", col=_c(col), q=alpha)


def ewm_recursive(col, alpha: float) -> Spec:
    """Recursion s = (w s + alpha x) / (w + alpha) started at the first value
    (adjust=False), where w = (1-alpha)**(rows since the value before)."""
    return Spec("ewmr", col=_c(col), q=alpha)


def _aggregate(agg: str, x: Column, q: float = 0.5) -> Column:
    return {
        "sum": lambda: F.sum(x),
        "count": lambda: F.count(x),
        "mean": lambda: F.avg(x),
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
        "std": lambda: F.stddev_samp(x),
        "quantile": lambda: F.percentile(x, F.lit(q)),
        "first": lambda: F.first(x, ignorenulls=True),
        "last": lambda: F.last(x, ignorenulls=True),
    }[agg]()


def _finish(value: Column, n: Column | None, spec: Spec) -> Column:
    if n is not None and spec.min_n > 1:
        value = F.when(n >= spec.min_n, value)
    if spec.default is not None:
        value = F.coalesce(value, F.lit(spec.default))
    return value


def _bounded(spec: Spec, w) -> Column:
    """lag / last-k expression over an ordered window."""
    if spec.kind == "lag":
        return _finish(F.lag(spec.col, spec.k).over(w), None, spec)
    frame = w.rowsBetween(-spec.k, -1)
    return _finish(_aggregate(spec.agg, spec.col, spec.q).over(frame), F.count(spec.col).over(frame), spec)


#: Natural-log span of one block of decayed sums; exp(BLOCK) must fit a double.
BLOCK = 200.0


def _add_ewm(df: DataFrame, keys: list[str], order: list[Column], specs: dict[str, Spec], hot: HotKeys | None) -> DataFrame:
    """Decayed sums in one step per row.

    Every known value i has a cumulative log decay A_i; a weighted sum as of the last
    known value is sum(c_i * exp(A_last - A_i)), a running sum of c_i * exp(-A_i) times
    exp(A_last).  To stay inside a double the running sum restarts whenever A has
    fallen by BLOCK; of the earlier blocks only the last one with values can still
    matter (the others weigh less than exp(-BLOCK))."""
    for name, spec in specs.items():
        df = df.withColumn("__x", spec.col.cast("double"))
        df = _apply(df, keys, order, {"__pos": seq()}, hot)
        known = F.col("__x").isNotNull()
        step = math.log(1.0 - spec.q)
        if spec.kind == "ewm":
            df = df.withColumn("__A", F.col("__pos") * F.lit(step)).withColumn("__c", F.col("__x"))
        else:
            df = _apply(df, keys, order, {"__lp": past("last", F.when(known, F.col("__pos")))}, hot)
            w = F.exp((F.col("__pos") - F.col("__lp")) * F.lit(step))
            df = df.withColumn("__la", F.when(known, F.coalesce(F.log(w / (w + spec.q)), F.lit(0.0))).otherwise(F.lit(0.0)))
            df = _apply(df, keys, order, {"__A0": past("sum", "__la", default=0.0)}, hot)
            df = df.withColumn("__A", F.col("__A0") + F.col("__la"))
            first = F.col("__lp").isNull()
            df = df.withColumn("__c", F.when(first, F.col("__x")).otherwise(F.col("__x") * (1 - F.exp("__la"))))
            df = df.drop("__lp", "__la", "__A0")
        df = df.withColumn("__B", F.floor(-F.col("__A") / BLOCK))
        scale = F.exp(-F.col("__A") - F.col("__B") * BLOCK)
        df = df.withColumn("__cs", F.when(known, F.col("__c") * scale)).withColumn("__ds", F.when(known, scale))
        df = _apply(df, keys, order, {"__last": past("last", F.when(known, F.col("__A")))}, hot)
        inner = [*keys, "__B"]
        sums = {"__wc": past("sum", "__cs", default=0.0), "__wd": past("sum", "__ds", default=0.0)}
        df = _apply(df, inner, order, sums, None if hot is None else hot_keys(df, inner))
        df = _previous_block(df if hot is None else cut_lineage(df), keys, hot)
        here = F.exp(F.col("__last") + F.col("__B") * BLOCK)
        back = F.coalesce(F.exp(F.col("__last") + F.col("__prev.b") * BLOCK), F.lit(0.0))
        num = F.when(F.col("__wd") > 0, here * F.col("__wc")).otherwise(0.0) + back * F.coalesce("__prev.c", F.lit(0.0))
        den = F.when(F.col("__wd") > 0, here * F.col("__wd")).otherwise(0.0) + back * F.coalesce("__prev.d", F.lit(0.0))
        value = F.try_divide(num, den) if spec.kind == "ewm" else num
        df = df.withColumn(name, F.when(F.col("__last").isNotNull(), value))
        df = df.drop("__x", "__pos", "__A", "__c", "__B", "__cs", "__ds", "__last", "__wc", "__wd", "__prev")
    return df


def _previous_block(df: DataFrame, keys: list[str], hot: HotKeys | None) -> DataFrame:
    """``__prev``: number and totals of the last earlier block of the key that has values."""
    total = lambda c, d: F.struct(F.col("__B").alias("b"), c.alias("c"), d.alias("d"))
    if hot is None:
        whole = Window.partitionBy(*keys, "__B")
        before = Window.partitionBy(*keys).orderBy("__B").rangeBetween(FIRST, -1)
        df = df.withColumn("__t", F.when(F.count("__ds").over(whole) > 0, total(F.sum("__cs").over(whole), F.sum("__ds").over(whole))))
        return df.withColumn("__prev", F.max("__t").over(before)).drop("__t")
    cells = df.groupBy(*keys, "__B").agg(F.sum("__cs").alias("c"), F.sum("__ds").alias("d"))
    cells = cells.withColumn("__t", F.when(F.col("d").isNotNull(), total(F.col("c"), F.col("d"))))
    before = Window.partitionBy(*keys).orderBy("__B").rowsBetween(FIRST, -1)
    side = cells.select(*keys, "__B", F.last("__t", ignorenulls=True).over(before).alias("__prev"))
    return _null_safe(df, side, [*keys, "__B"])


#: A frame with this column is several frames in one; histories never mix them.
COPY = "copy_no"


def own_keys(df: DataFrame, keys) -> list[str]:
    """The key columns, and the copy a row belongs to if the frame has copies."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return [*keys, COPY] if COPY in df.columns and COPY not in keys else keys


def history(df: DataFrame, keys, order, **specs: Spec) -> DataFrame:
    keys = own_keys(df, keys)
    order = [_c(o) for o in ([order] if isinstance(order, (str, Column)) else order)]
    weighted = {n: s for n, s in specs.items() if s.kind.startswith("ewm")}
    ranked = {n: s for n, s in specs.items() if s.kind == "past" and s.agg == "quantile"}
    plain = {n: s for n, s in specs.items() if n not in weighted and n not in ranked}
    hot = hot_keys(df, keys)
    if plain:
        df = _apply(df, keys, order, plain, hot)
    if ranked:
        from .quantiles import expanding_quantile  # which stands on this module

        for n, s in ranked.items():
            df = expanding_quantile(df, keys, order, s.col, s.q, n, s.min_n)
            df = df if s.default is None else df.withColumn(n, F.coalesce(F.col(n), F.lit(s.default)))
    return _add_ewm(df, keys, order, weighted, hot) if weighted else df


def _apply(df: DataFrame, keys, order, specs, hot: HotKeys | None) -> DataFrame:
    if hot is None:
        return _plain(df, keys, order, specs)
    return _split(cut_lineage(df), keys, order, specs, hot)


def _plain(df: DataFrame, keys, order, specs) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(FIRST, -1)
    out = {}
    for name, s in specs.items():
        if s.kind == "seq":
            out[name] = (F.row_number().over(w) - 1).cast("long")
        elif s.kind == "past":
            out[name] = _finish(_aggregate(s.agg, s.col).over(before), F.count(s.col).over(before), s)
        else:
            out[name] = _bounded(s, w)
    return df.select("*", *[c.alias(n) for n, c in out.items()])


# --- hot keys ---------------------------------------------------------------


def _as_number(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DateType):
        return F.datediff(col, F.lit(EPOCH).cast("date")).cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col).cast("double")
    return col.cast("double")


def _with_segments(df: DataFrame, keys, order, hot: HotKeys) -> tuple[DataFrame, DataFrame]:
    """Cold rows, and hot rows with ``__seg``: equal-depth slices of the first order column.

    Cut points come from a mergeable quantile sketch per hot key.  They are held
    as two levels of about sqrt(m) so a row finds its slice in 2*sqrt(m) steps.
    """
    dtype = df.select(order[0].alias("o")).schema["o"].dataType
    df = df.withColumn("__ord", _as_number(order[0], dtype))
    cold, heavy = tag_hot(df, hot, hot.table.select(*keys, "__class"))
    rows, schema = [], None
    for c in hot.classes():  # keys of one class, twice the size apart, get the same number of cuts
        side = math.ceil(math.sqrt(2 ** (c + 2)))
        m = side * side
        own = heavy.filter(F.col("__class") == c).groupBy(*keys)
        cuts = own.agg(F.percentile_approx("__ord", [i / m for i in range(1, m)], 20 * m).alias("__cuts"))
        cuts = cuts.withColumn("__cutside", F.lit(side))
        # As many numbers as the rows of hot keys hold limits; collected so that both uses below see the same cuts.
        rows, schema = rows + cuts.collect(), cuts.schema
    cuts = df.sparkSession.createDataFrame(rows, schema)
    cuts = cuts.select(
        *keys,
        "__cutside",
        F.expr("transform(sequence(1, __cutside - 1), i -> __cuts[i * __cutside - 1])").alias("__coarse"),
        F.expr("transform(sequence(0, __cutside - 1), i -> slice(__cuts, i * __cutside + 1, __cutside - 1))").alias("__fine"),
    )
    cold, heavy = tag_hot(df, hot, cuts)
    block = F.size(F.filter("__coarse", lambda b: b < F.col("__ord")))
    within = F.size(F.filter(F.element_at("__fine", F.col("__block") + 1), lambda b: b < F.col("__ord")))
    heavy = heavy.withColumn("__block", F.when(F.col("__ord").isNull(), -1).otherwise(block))
    heavy = heavy.withColumn(
        "__seg", F.when(F.col("__block") < 0, F.lit(-1)).otherwise(F.col("__block") * F.col("__cutside") + within).cast("int")
    )
    return cold.drop("__ord"), heavy.drop("__ord", "__block", "__coarse", "__fine", "__cutside")


def _split(df: DataFrame, keys, order, specs, hot: HotKeys) -> DataFrame:
    cold, heavy = _with_segments(df, keys, order, hot)
    columns = df.columns
    part = [*keys, "__seg"]
    bounded = {n: s for n, s in specs.items() if s.kind in ("lag", "last")}
    depth = max((s.k for s in bounded.values()), default=0)

    rows = heavy.withColumn("__halo", F.lit(False))
    sizes = heavy.groupBy(*part).agg(F.count(F.lit(1)).alias("__rows"))
    ws = Window.partitionBy(*keys).orderBy("__seg")
    sizes = sizes.select(
        *part,
        F.row_number().over(ws).alias("__i"),
        F.coalesce(F.sum("__rows").over(ws.rowsBetween(FIRST, -1)), F.lit(0)).alias("__before"),
        F.sum("__rows").over(ws.rowsBetween(FIRST, 0)).alias("__upto"),
    )
    if depth:
        rows = rows.unionByName(_halo(heavy, keys, part, order, sizes, depth, columns))

    w = Window.partitionBy(*part).orderBy(*order)
    before = w.rowsBetween(FIRST, -1)
    own = ~F.col("__halo")
    local, carried = {}, {}
    for name, s in specs.items():
        if s.kind in ("lag", "last"):
            local[name] = _bounded(s, w)
        elif s.kind == "seq":
            local[f"{name}__n"] = F.count(F.when(own, F.lit(1))).over(before)
        else:
            x = F.when(own, s.col)
            if s.agg not in ("sum", "count", "mean", "min", "max", "std", "first", "last"):
                raise ValueError(f"{s.agg} has no exact partial form over an unbounded history")
            local[f"{name}__n"] = F.count(x).over(before)
            if s.agg in ("sum", "mean", "std"):
                local[f"{name}__s"] = F.sum(x).over(before)
            if s.agg == "std":
                local[f"{name}__v"] = F.var_pop(x).over(before)
            if s.agg in ("min", "max", "first", "last"):
                local[f"{name}__e"] = _aggregate(s.agg, x).over(before)
            carried[name] = s
    rows = rows.select("*", *[c.alias(n) for n, c in local.items()]).filter(own)
    rows = _join_carry(rows, heavy, keys, part, order, carried, sizes)

    out = []
    for name, s in specs.items():
        if s.kind in ("lag", "last"):
            out.append(F.col(name))
        elif s.kind == "seq":
            out.append((F.col(f"{name}__n") + F.col("__before")).cast("long").alias(name))
        else:
            out.append(_combine(name, s).alias(name))
    return _plain(cold, keys, order, specs).unionByName(rows.select(*columns, *out))


def _halo(heavy, keys, part, order, sizes, depth, columns) -> DataFrame:
    """Copies of the last ``depth`` rows before each segment.

    A row r places from the end of its segment is needed by a later segment iff
    r plus the rows lying between them is at most ``depth``; every segment has a
    row, so only the next depth-r+1 segments can qualify.
    """
    back = Window.partitionBy(*part).orderBy(*[o.desc_nulls_last() for o in order])
    tails = heavy.withColumn("__r", F.row_number().over(back)).filter(F.col("__r") <= depth)
    tails = _null_safe(tails, F.broadcast(sizes.drop("__before")), part).drop("__seg")
    tails = tails.withColumn("__j", F.explode(F.sequence(F.lit(1), F.lit(depth + 1) - F.col("__r"))))
    tails = tails.withColumn("__i", (F.col("__i") + F.col("__j")).cast("int"))
    nxt = sizes.select(*keys, "__seg", "__i", "__before")
    return (
        _null_safe(tails, nxt, [*keys, "__i"])
        .filter(F.col("__r") + F.col("__before") - F.col("__upto") <= depth)
        .select(*columns, "__seg", F.lit(True).alias("__halo"))
    )


def _null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which NULL keys match each other."""
    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in on]
    return left.alias("l").join(right.alias("r"), cond).select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in on])


def _join_carry(rows, heavy, keys, part, order, carried, sizes) -> DataFrame:
    if carried:
        stamp = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
        parts = []
        for name, s in carried.items():
            x = s.col
            parts += [F.count(x).alias(f"{name}__pn"), F.sum(x.cast("double") if s.agg == "std" else x).alias(f"{name}__ps")] \
                if s.agg in ("sum", "mean", "std", "count") else [F.count(x).alias(f"{name}__pn")]
            if s.agg == "std":
                parts.append(F.var_pop(x).alias(f"{name}__pv"))
            if s.agg in ("min", "max"):
                parts.append(_aggregate(s.agg, x).alias(f"{name}__pe"))
            if s.agg in ("first", "last"):
                pick = F.min_by if s.agg == "first" else F.max_by
                parts.append(pick(x, F.when(x.isNotNull(), stamp)).alias(f"{name}__pe"))
        partial = heavy.groupBy(*part).agg(*parts)
        before = Window.partitionBy(*keys).orderBy("__seg").rowsBetween(FIRST, -1)
        carry = []
        for name, s in carried.items():
            n, t, v, e = (F.col(f"{name}__p{x}") for x in "nsve")
            carry.append(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{name}__cn"))
            if s.agg in ("sum", "mean", "std"):
                carry.append(F.sum(t).over(before).alias(f"{name}__cs"))
            if s.agg == "std":
                carry.append(F.sum(v * n + F.try_divide(t * t, n)).over(before).alias(f"{name}__cq"))
            if s.agg in ("min", "max", "first", "last"):
                carry.append(_aggregate(s.agg, e).over(before).alias(f"{name}__ce"))
        sizes = _null_safe(sizes, partial.select(*part, *carry), part)
    # A few rows for each limit of rows of the hot keys: they go to the rows, which stay where their window is.
    return _null_safe(rows, F.broadcast(sizes), part)


def _combine(name: str, s: Spec) -> Column:
    n = F.coalesce(F.col(f"{name}__n"), F.lit(0)) + F.col(f"{name}__cn")
    if s.agg == "count":
        value = n
    elif s.agg in ("sum", "mean", "std"):
        a, b = F.col(f"{name}__s"), F.col(f"{name}__cs")
        total = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
        if s.agg == "sum":
            value = total
        elif s.agg == "mean":
            value = F.try_divide(total, n)
        else:
            ln, cn = F.col(f"{name}__n"), F.col(f"{name}__cn")
            m2 = (
                F.coalesce(F.col(f"{name}__v") * ln + F.try_divide(a * a, ln), F.lit(0.0))
                + F.coalesce(F.col(f"{name}__cq"), F.lit(0.0))
                - F.try_divide(total * total, n)
            )
            value = F.when(n > 1, F.sqrt(F.greatest(m2, F.lit(0.0)) / (n - 1)))
    else:
        a, b = F.col(f"{name}__e"), F.col(f"{name}__ce")
        value = {
            "min": F.least(a, b),
            "max": F.greatest(a, b),
            "last": F.coalesce(a, b),
            "first": F.coalesce(b, a),
        }[s.agg]
    return _finish(value, n, replace(s))
