"""Recurrences whose next state needs the previous one.

Each independent key (a rating pool, a strategy) is folded in time order by one task.
The fold takes the history in stretches or time slices of bounded size and carries
only the state between them, so no task ever holds more than one of these rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.hot import cut_lineage, freed, hot_row_limit

#: Rows of a slice: whole rows as Python objects, of which the memory beside the JVM holds far fewer than a task does.
FOLD_ROWS = 500_000

START, STEP, SPREAD = 1500.0, 32.0, 400.0  # fixed values of the rating formula


def _slices(df: DataFrame, key: str, order: str) -> list:
    """Cut points of ``order`` so that no (key, slice) exceeds the row limit, as far as
    equal-depth cuts of the largest key allow; empty when one slice is enough."""
    limit = min(hot_row_limit(df), FOLD_ROWS)
    top = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc()).first()
    if top is None or top["n"] <= limit:
        return []
    m = math.ceil(2 * top["n"] / limit)
    cuts = df.filter(F.col(key).eqNullSafe(F.lit(top[key]))).agg(
        F.percentile_approx(order, [i / m for i in range(1, m)], 20 * m).alias("c")
    ).first()["c"]
    return sorted(set(cuts))


def _rate_groups(r: np.ndarray, outcome: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """New ratings of the rows of whole groups: each row against the mean rating of its field."""
    ok = ~np.isnan(outcome) & (outcome > 0)
    n = np.add.reduceat(ok.astype(np.int64), starts)
    mean = np.add.reduceat(np.where(ok, r, 0.0), starts) / np.maximum(n, 1)
    expected = 1.0 / (1.0 + 10.0 ** ((np.repeat(mean, sizes) - r) / SPREAD))
    size = np.repeat(sizes, sizes)
    actual = np.where(size > 1, (size - outcome) / np.maximum(size - 1, 1), (outcome == 1).astype(float))
    return np.where(ok, r + STEP * (actual - expected), r)


def _members(of: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of some stretches, and where each of these begins among them."""
    n = sizes[of]
    at = np.cumsum(n) - n
    return np.arange(n.sum()) + np.repeat(starts[of] - at, n), at


def _fold_groups(ents: np.ndarray, outs: np.ndarray, starts: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Ratings before their group of rows in time order.  ``ents`` are places in ``state``, which is brought up to date.

    Groups depend on each other only through the entities they share: all groups whose entities have no group before them
    are rated at once, then those that waited for these.  Where an entity is in a large part of the groups there is little
    to be done at once, and they are taken one by one.
    """
    sizes = np.diff(np.append(starts, len(ents)))
    of = np.repeat(np.arange(len(starts)), sizes)
    by = np.argsort(ents, kind="stable")
    other = ents[by][1:] != ents[by][:-1]
    # A visit: the rows of an entity in one group, which lie together in ``by``.
    first = np.flatnonzero(np.append(True, other | (of[by][1:] != of[by][:-1])))
    length = np.diff(np.append(first, len(by)))
    newest = by[first + length - 1]
    opens = np.append(True, other)[first]
    before = state[ents]
    if np.diff(np.append(np.flatnonzero(opens), len(first))).max() * 8 > len(starts):
        zero = np.zeros(1, np.int64)
        for a, n in zip(starts.tolist(), sizes.tolist()):
            who = ents[a:a + n]
            before[a:a + n] = state[who]
            for e, v in zip(who.tolist(), _rate_groups(before[a:a + n], outs[a:a + n], zero, np.array([n])).tolist()):
                state[e] = v
        return before
    after = np.empty(len(ents))
    heir = np.full(len(ents), -1)  # the next visit of the entity, to which the last row of a visit hands its rating
    heir[newest[:-1]] = np.where(opens[1:], -1, np.arange(1, len(first)))
    waits = np.bincount(of[by[first[~opens]]], minlength=len(starts))
    ready = np.flatnonzero(waits == 0)
    while len(ready):
        rows, at = _members(ready, starts, sizes)
        after[rows] = _rate_groups(before[rows], outs[rows], at, sizes[ready])
        rows = rows[heir[rows] >= 0]
        to = heir[rows]
        before[by[_members(to, first, length)[0]]] = np.repeat(after[rows], length[to])
        told, n = np.unique(of[by[first[to]]], return_counts=True)
        waits[told] -= n
        ready = told[waits[told] == 0]
    ends = newest[np.append(opens[1:], True)]
    state[ents[ends]] = after[ends]
    return before


class _Known:
    """Ratings of the entities of one pool seen so far: two arrays in the order of the ids, or a dict where ids are no numbers."""

    def __init__(self):
        self.ids, self.values, self.named = None, np.empty(0), {}

    def fold(self, ents: pd.Series, outs: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not pd.api.types.is_numeric_dtype(ents.dtype):
            at, ids = pd.factorize(ents.to_numpy(dtype=object), use_na_sentinel=False)
            state = np.array([self.named.get(e, START) for e in ids])
            before = _fold_groups(at, outs, starts, state)
            self.named.update(zip(ids, state))
            return before
        # Rows without an entity never meet each other: each is a number of its own, and is not kept.
        some = ents.notna().to_numpy()
        ids, at = np.unique(ents.to_numpy()[some], return_inverse=True)
        places = np.empty(len(ents), np.int64)
        places[some], places[~some] = at, len(ids) + np.arange(len(ents) - len(at))
        state = np.full(len(ids) + len(ents) - len(at), START)
        old = np.zeros(len(ids), bool)
        if self.ids is not None and len(self.ids):
            where = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
            old = self.ids[where] == ids
            state[:len(ids)][old] = self.values[where[old]]
        before = _fold_groups(places, outs, starts, state)
        now = state[:len(ids)]
        if old.any():
            self.values[where[old]] = now[old]
        if not old.all():
            every = ids[~old] if self.ids is None else np.concatenate([self.ids, ids[~old]])
            order = np.argsort(every, kind="stable")
            self.ids, self.values = every[order], np.concatenate([self.values, now[~old]])[order]
        return before


def _fold_ratings(batches: Iterator[pa.RecordBatch], cols, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows come by pool and in time order.  At least ``limit`` rows at a time, whole groups of one pool, are rated; between
    these only the ratings of the pool's entities are kept."""
    pool, group, entity, outcome = cols
    known, held, n, at = _Known(), [], 0, None

    def breaks(t: pa.Table, c: str) -> np.ndarray:
        """Rows that begin another value of ``c``."""
        x = pc.dictionary_encode(t[c], null_encoding="encode").combine_chunks()
        x = x.indices if isinstance(x, pa.DictionaryArray) else x.chunk(0).indices
        x = x.to_numpy(zero_copy_only=False)
        return np.append(True, x[1:] != x[:-1]) if len(x) else np.zeros(0, bool)

    def rated(t: pa.Table) -> pa.Table:
        """Rows of one pool."""
        begins = breaks(t, group)
        if not pa.types.is_string(t.schema.field(group).type):  # a row without a group is one of its own
            begins |= pc.is_null(t[group]).to_numpy(zero_copy_only=False)
        outs = t[outcome].cast(pa.float64()).to_pandas().to_numpy(dtype=float)
        before = known.fold(t[entity].to_pandas(), outs, np.flatnonzero(begins))
        return t.append_column("rating", pa.array(before))

    def done(t: pa.Table, end: bool) -> Iterator[pa.RecordBatch]:
        """Everything but what may go on in the next rows."""
        nonlocal known, held, n, at
        starts = np.flatnonzero(breaks(t, pool))
        for a, b in zip(starts, np.append(starts[1:], len(t))):
            part, last = t.slice(a, b - a), b == len(t)
            if part[pool][0] != at:
                known, at = _Known(), part[pool][0]
            keep = 0
            if last and not end:
                begins = np.flatnonzero(breaks(part, group))
                keep = len(part) - int(begins[-1])
            if len(part) > keep:
                yield from rated(part.slice(0, len(part) - keep)).combine_chunks().to_batches()
        held = [t.slice(len(t) - keep)] if keep else []
        n = keep

    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n >= limit:
                before = n
                yield from done(pa.concat_tables(held), False)
                if n == before:  # one group of more rows than that
                    limit = 2 * n
    if held:
        yield from done(pa.concat_tables(held), True)


def _tasks(df: DataFrame, key: str) -> int:
    """Partitions by hash of ``key`` that put the fewest rows of the input into one task."""
    least = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    found = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.hash(key).alias("h")).limit(1001)
    with freed(df.sparkSession):
        keys = found.collect()
    if not 1 < len(keys) <= 1000:
        return least
    n, h = np.array([r["n"] for r in keys]), np.array([r["h"] for r in keys])
    return min(range(least, 4 * least + 64), key=lambda m: (np.bincount(h % m, n).max(), m))


def ratings(df: DataFrame, pool: str, group: str, entity: str, outcome: str, time: str, ties: list[str]) -> DataFrame:
    """Add ``rating``: the rating of the entity before this group (start 1500, K 32,
    expected score against the field mean).  Pools never meet each other.

    A row's rating feeds later groups of the same pool, so a pool is folded in order by one task; pools run in parallel.
    The task takes the sorted rows as they come and holds a stretch of them and the ratings of the pool's entities.
    """
    order = [F.col(c).asc_nulls_last() for c in (time, group, *ties)]
    cols, limit = (pool, group, entity, outcome), min(hot_row_limit(df), FOLD_ROWS)
    schema = T.StructType([*df.schema.fields, T.StructField("rating", T.DoubleType())])
    dealt = df.repartition(_tasks(df, pool), pool).sortWithinPartitions(pool, *order)
    # Kept, so that what reads the ratings more than once does not fold again.
    return cut_lineage(dealt.mapInArrow(lambda batches: _fold_ratings(batches, cols, limit), schema))


def capped_stake(planned: float, equity: float, fraction: float, floor: float, unit: float, mode: str) -> float:
    """Stake allowed by the bankroll: at most a fraction of it, whole units, none below the floor."""
    if equity < floor:
        return 0.0
    limit = equity * fraction
    if planned <= limit:
        return planned
    if mode == "skip":
        return 0.0
    return float(int(limit / unit) * unit)


def capped_equity(
    ledger: DataFrame, strategy: str, order: list[str], planned: str, gross: str,
    bankroll: float = 100_000.0, fraction: float = 0.05, floor: float = 1_000.0, unit: float = 100.0, mode: str = "scale",
) -> DataFrame:
    """Sequential bankroll per strategy: the stake depends on the bankroll left, the
    payout shrinks with the stake, and play stops below the floor.

    Strategies run in parallel; a long ledger is taken in slices, carrying one
    number per strategy.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ledger.schema.fields)
    schema += ", executed double, returned double, equity double"

    def run(pdf: pd.DataFrame, money: float) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        ex, ret, eq = [], [], []
        for want, pays in zip(pdf[planned].to_numpy(dtype=float), pdf[gross].to_numpy(dtype=float)):
            bet = capped_stake(want, money, fraction, floor, unit, mode)
            back = pays * bet / want if want > 0 else 0.0
            money = max(0.0, money + back - bet)
            ex.append(bet), ret.append(back), eq.append(money)
        return pdf.assign(executed=ex, returned=ret, equity=eq)

    cuts = _slices(ledger, strategy, order[0])
    if not cuts:
        return ledger.groupBy(strategy).applyInPandas(lambda p: run(p, bankroll), schema)
    ledger = cut_lineage(ledger)  # every slice reads it
    state, done = None, None
    bounds = [None, *cuts, None]
    for lo, hi in zip(bounds, bounds[1:]):
        part = ledger
        if lo is not None:
            part = part.filter(F.col(order[0]) > F.lit(lo))
        if hi is not None:
            part = part.filter(F.col(order[0]) <= F.lit(hi))
        if state is None:
            piece = part.groupBy(strategy).applyInPandas(lambda p: run(p, bankroll), schema)
        else:
            piece = part.join(F.broadcast(state), strategy, "left").groupBy(strategy).applyInPandas(
                lambda p: run(p.drop(columns="__m"), bankroll if pd.isna(p["__m"].iloc[0]) else p["__m"].iloc[0]), schema
            )
        piece = cut_lineage(piece)
        last = piece.groupBy(strategy).agg(F.max_by("equity", F.struct(*order)).alias("__m"))
        if state is not None:
            last = last.unionByName(state.join(last, strategy, "left_anti"))
        state = cut_lineage(last)
        done = piece if done is None else done.unionByName(piece)
    return done
