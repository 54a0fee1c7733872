"""Do the derived tables keep up with their input?"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pedalgrid.constants import FRESHNESS_TOLERANCE_MINUTES
from pedalgrid.functions.timeutil import seconds_between


def freshness_check(
    chain: Sequence[tuple[str, DataFrame | None, str]],
    tolerance_minutes: int = FRESHNESS_TOLERANCE_MINUTES,
) -> DataFrame:
    """For tables in order of derivation: newest instant, lag behind the table before, verdict.

    An empty or absent table (None) is missing, and the next one is then judged on its own.
    At least one table must be there.
    """
    spark = next(df for _, df, _ in chain if df is not None).sparkSession

    def latest(df: DataFrame | None, col: str) -> DataFrame:
        if df is None:
            return spark.range(1).select(F.lit(None).cast("timestamp").alias("latest"))
        return df.agg(F.max(col).alias("latest"))

    newest = reduce(
        DataFrame.unionByName,
        [
            latest(df, col).select(F.lit(i).alias("step"), F.lit(name).alias("table"), "latest")
            for i, (name, df, col) in enumerate(chain)
        ],
    )
    before = F.lag("latest").over(W.orderBy("step"))  # one row per table
    lag = F.coalesce(seconds_between(F.col("latest"), before) / 60, F.lit(0.0))
    state = (
        F.when(F.col("latest").isNull(), "MISSING")
        .when(F.col("lag_minutes") > tolerance_minutes, "STALE")
        .otherwise("ok")
    )
    return (
        newest.withColumn("lag_minutes", F.when(F.col("latest").isNotNull(), lag))
        .withColumn("state", state)
        .orderBy("step")
    )


def source_lag(
    source: DataFrame,
    mirror: DataFrame,
    time_col: str,
    tolerance_minutes: int = FRESHNESS_TOLERANCE_MINUTES,
) -> DataFrame:
    """Hours the local copy is behind its source."""
    both = source.agg(F.max(time_col).alias("source_latest")).withColumn(
        "mirror_latest", mirror.agg(F.max(time_col)).scalar()
    )
    behind = seconds_between(F.col("mirror_latest"), F.col("source_latest")) / 3600
    return both.withColumn("hours_behind", behind).withColumn(
        "stale", F.col("hours_behind") > tolerance_minutes / 60
    )
