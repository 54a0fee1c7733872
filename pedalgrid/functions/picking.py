"""First and last row per key as a hash aggregation with map-side combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df, keys, order, cols, picker) -> DataFrame:
    by = F.col(order) if isinstance(order, str) else order
    kept = [c for c in (cols or df.columns) if c not in keys]
    return df.groupBy(*keys).agg(*(picker(F.col(c), by).alias(c) for c in kept))


def latest_per(
    df: DataFrame, keys: Sequence[str], order: str | Column, cols: Sequence[str] | None = None
) -> DataFrame:
    """The row with the greatest ``order`` of each key; ``order`` must be unique per key.

    A key with very many rows shrinks to one row per input partition before the shuffle.
    """
    return _pick(df, keys, order, cols, F.max_by)


def first_per(
    df: DataFrame, keys: Sequence[str], order: str | Column, cols: Sequence[str] | None = None
) -> DataFrame:
    """The row with the smallest ``order`` of each key; ``order`` must be unique per key."""
    return _pick(df, keys, order, cols, F.min_by)
