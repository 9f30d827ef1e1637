"""Vectors of an array column as numpy matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def dimension(df: DataFrame, vector: str) -> int | None:
    """The most frequent length of the usable vectors (the larger one of two); None without any."""
    row = df.filter(usable(F.col(vector))).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return row["d"] if row else None


def matrix(column) -> np.ndarray:
    """An Arrow list column of equally long rows without nulls as a float64 matrix."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def complete(vector: Column) -> Column:
    """Neither null nor empty, and without a null or non-finite component; all zero is allowed."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def common_length(df: DataFrame, vector: str, multiple: int = 1) -> int | None:
    """The most frequent length of the complete vectors that is a multiple of ``multiple`` (the larger one of two)."""
    row = df.filter(complete(F.col(vector)) & (F.size(vector) % multiple == 0)).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return row["d"] if row else None
