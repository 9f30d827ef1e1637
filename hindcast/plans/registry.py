"""Query registry: name -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
MODULES = [
    "scans", "projections", "joins", "aggregates", "calibrations", "histories", "groupwise",
    "scalars", "decisions", "tickets", "audits", "blocks", "streams",
]


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()):
    """Register a query.  ``dates`` are returned as ISO text on both sides."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        run, text = fn, sql
        if dates:
            run = lambda spark, sf: fn(spark, sf).withColumns({c: F.col(c).cast("string") for c in dates})
            if sql:
                casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
                text = f"SELECT * REPLACE ({casts}) FROM ({sql})"
        QUERIES[name] = Query(run, text)
        return fn

    return add


def load_all() -> dict[str, Query]:
    for m in MODULES:
        importlib.import_module(f"hindcast.catalog.{m}")
    return QUERIES
