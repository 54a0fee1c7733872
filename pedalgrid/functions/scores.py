"""Ranking scores over very many rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedalgrid.functions.ordered import running_totals
from pedalgrid.session import cut_lineage


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation; NULL when one side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def average_precision(
    scored: DataFrame, keys: Sequence[str], score: str, label: str
) -> DataFrame:
    """Per key: rows, positives and sum over score steps of (recall gain x precision).

    Rows with one score form one step however many they are, so they are counted first;
    the running sums over the steps are cut into score ranges.
    """
    steps = cut_lineage(
        scored.groupBy(*keys, score).agg(
            F.count("*").alias("rows"), F.sum(F.col(label).cast("bigint")).alias("hits")
        ),
        "steps",
    )
    totals = running_totals(steps, keys, score, ["rows", "hits"], descending=True)
    precision = F.col("cum_hits") / F.col("cum_rows")
    return totals.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        F.sum("hits").alias("positives"),
        F.try_divide(F.sum(F.col("hits") * precision), F.sum("hits")).alias("ap"),
    )
