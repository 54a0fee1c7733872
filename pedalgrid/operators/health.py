"""Station health: enough stock for the demand until a van can come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedalgrid.constants import ACTION_WINDOW_MINUTES
from pedalgrid.functions.timeutil import with_local_clock
from pedalgrid.operators.demand import with_demand


def station_health(
    grid: DataFrame, demand: DataFrame, window_minutes: int = ACTION_WINDOW_MINUTES, clock: bool = False
) -> DataFrame:
    """A row per grid row with demand; with ``clock`` also its daytype and hour, by which demand is known."""
    ebikes, serving = F.col("num_ebikes_available"), F.col("is_serving")
    expected = F.col("expected_demand")
    rows = with_demand(grid, demand).withColumn(
        "expected_demand", F.col("ebike_demand_per_hour") * window_minutes / 60.0
    )
    return rows.select(
        "bucket",
        "station_id",
        ebikes.alias("ebikes"),
        "is_serving",
        "expected_demand",
        "low_confidence",
        ((ebikes > 0) & serving).alias("healthy_old"),
        (serving & (ebikes >= expected)).alias("healthy_new"),
        (serving & (ebikes > 0) & (ebikes < expected)).alias("falsely_healthy"),
        *(["daytype", "hour"] if clock else []),
    )


def _share(flag: str):
    return F.try_divide(F.count_if(F.col(flag)), F.count("*"))


def health_shares(health: DataFrame) -> DataFrame:
    return health.filter(~F.col("low_confidence")).agg(
        F.count("*").alias("cells"),
        _share("healthy_old").alias("healthy_old"),
        _share("healthy_new").alias("healthy_new"),
        _share("falsely_healthy").alias("falsely_healthy"),
    )


def health_by_hour(health: DataFrame, daytype: str = "weekday") -> DataFrame:
    sure = health.filter(~F.col("low_confidence"))
    if not {"daytype", "hour"} <= set(health.columns):
        sure = with_local_clock(sure)
    return (
        sure.filter(F.col("daytype") == daytype)
        .groupBy("hour")
        .agg(_share("healthy_old").alias("old_share"), _share("healthy_new").alias("new_share"))
        .withColumn("overstated", F.col("old_share") - F.col("new_share"))
        .orderBy("hour")
    )
