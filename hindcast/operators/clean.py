"""Filters, sentinel cleaning, imputation and schema guards."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .quantiles import exact_quantiles

# Columns that carry the result of the row itself.
FORBIDDEN_COLUMNS = [
    "rank", "time", "rank_norm", "passing_rank", "last_3f", "time_index", "last_3f_index", "honshokin", "prize",
    "rank_str", "raw_time", "pass_1", "pass_2", "pass_3", "pass_4", "weight_diff_val", "weight_diff_sign", "outcome",
]
# Words that mark a result, and the words that make it a past result.
RESULT_WORDS = ["rank", "time", "payout", "prize", "outcome", "last_3f"]
HISTORY_WORDS = ["lag", "mean", "avg", "rate", "prev", "past", "count"]


def by_organisation(df: DataFrame, key: str, codes: list[str]) -> DataFrame:
    """Groups whose key carries one of the organisation codes at its fifth character."""
    return df.filter(F.substring(key, 5, 1).isin(codes))


def years(df: DataFrame, day: str, first: int, last: int, holdout: int | None = None, allow_holdout: bool = False) -> DataFrame:
    """Rows of the year range; touching the hold-out year needs ``allow_holdout``.

    The range is written as a date interval so that it reaches the scan.
    """
    if holdout is not None and first <= holdout <= last and not allow_holdout:
        raise ValueError(f"year {holdout} is held out")
    d = F.col(day)
    return df.filter((d >= F.lit(f"{first}-01-01").cast("date")) & (d < F.lit(f"{last + 1}-01-01").cast("date")))


def finished_or_future(df: DataFrame, outcome: str, day: str, today) -> DataFrame:
    o = F.col(outcome)
    return df.filter((o.isNotNull() & (o != 0)) | (F.col(day) >= F.lit(today).cast("date")))


@dataclass(frozen=True)
class Sentinel:
    """Values of a column that mean 'unknown', and what to put there:
    null | zero | mean | median (of the valid values, ``default`` if there are none)."""

    column: str
    invalid: Column
    action: str
    default: float | None = None


def sentinels(df: DataFrame, rules: list[Sentinel]) -> DataFrame:
    """Apply all rules; one pass for the means, shared passes for the medians."""
    stats, medians = [], {}
    for r in rules:
        valid = F.when(~F.coalesce(r.invalid, F.lit(True)), F.col(r.column).cast("double"))
        if r.action == "mean":
            stats.append(F.avg(valid).alias(r.column))
        elif r.action == "median":
            medians[r.column] = (valid, 0.5)
    found = {**(df.agg(*stats).first().asDict() if stats else {}), **exact_quantiles(df, medians)}
    out = {}
    for r in rules:
        fill = {"null": None, "zero": 0}.get(r.action, found.get(r.column))
        if fill is None:
            fill = r.default
        out[r.column] = F.when(F.coalesce(r.invalid, F.lit(True)), F.lit(fill)).otherwise(F.col(r.column))
    return df.withColumns(out)


def impute(df: DataFrame, medians: list[str], zeros: list[str] = ()) -> DataFrame:
    """NULLs to the column median (shared passes for all columns) or to 0."""
    found = exact_quantiles(df, {c: (F.col(c), 0.5) for c in medians})
    return df.withColumns(
        {**{c: F.coalesce(F.col(c), F.lit(found[c])) for c in medians}, **{c: F.coalesce(F.col(c), F.lit(0)) for c in zeros}}
    )


def missing_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_is_missing": F.col(c).isNull().cast("int") for c in columns})


def rescale_if_large(df: DataFrame, column: str, limit: float = 100.0, factor: float = 10.0) -> DataFrame:
    """Divide the whole column when its maximum exceeds ``limit``."""
    top = df.agg(F.max(column)).first()[0]
    return df.withColumn(column, F.col(column) / factor) if top is not None and top > limit else df


def guard_columns(columns: list[str], forbidden=FORBIDDEN_COLUMNS) -> None:
    leaked = sorted(set(columns) & set(forbidden))
    if leaked:
        raise ValueError(f"result columns among the features: {leaked}")


def allowed_columns(columns: list[str], keys: list[str], exclude: list[str] = (), forbidden=FORBIDDEN_COLUMNS) -> list[str]:
    """Feature allowlist: no keys, no result columns, no excluded pattern; missing flags always."""
    out = []
    for c in columns:
        if c in keys or c in forbidden:
            continue
        if c.endswith("_is_missing") or not any(re.search(p, c) for p in exclude):
            out.append(c)
    return out


def suspicious_columns(columns: list[str]) -> list[str]:
    """Columns named after a result without a word that makes it a past one."""
    return [c for c in columns if any(w in c for w in RESULT_WORDS) and not any(w in c for w in HISTORY_WORDS)]


def conform(df: DataFrame, expected: list[str]) -> DataFrame:
    """Exactly the expected numeric columns in order; absent ones 0.0, NULLs 0.0."""
    have = set(df.columns)
    return df.select(
        *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c) for c in expected]
    )


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order`` (map-side combined, no sort of the group)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, "__best.*").select(*df.columns)


def unpivot_slots(df: DataFrame, keys: list[str], kinds: list[str], slots: int, prefix: str) -> DataFrame:
    """Numbered column pairs <prefix>_<kind>_<i>a / ..b to rows (type, selections, payout);
    blank and zero slots are dropped."""
    cells = [
        F.struct(F.lit(k).alias("bet_type"), F.trim(F.col(f"{prefix}_{k}_{i}a")).alias("sel"), F.trim(F.col(f"{prefix}_{k}_{i}b")).alias("pay"))
        for k in kinds for i in range(1, slots + 1) if f"{prefix}_{k}_{i}a" in df.columns
    ]
    out = df.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.bet_type", "c.sel", F.col("c.pay").try_cast("long").alias("payout"))
    return out.filter((F.col("sel") != "") & ~F.col("sel").rlike("^0*$") & (F.col("payout") > 0))
