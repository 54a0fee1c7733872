"""Do the demand estimates agree with an independent trip archive?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedalgrid.functions.ordered import value_ranks
from pedalgrid.functions.scores import safe_corr
from pedalgrid.functions.timeutil import is_weekend
from pedalgrid.operators.deltas import latest_station_info

ARCHIVE_HOURS = 65.0 * 24  # weekday hours of the archive's three months


def _weekday_ebike_trips(trips: DataFrame) -> DataFrame:
    ebike = F.col("rideable_type") == "electric_bike"
    return trips.filter(ebike & ~is_weekend(F.col("started_at")))


def _weekday_demand(demand: DataFrame) -> DataFrame:
    return demand.filter(~F.col("low_confidence") & (F.col("daytype") == "weekday"))


def demand_vs_trips(
    info: DataFrame, demand: DataFrame, trips: DataFrame, hours: float = ARCHIVE_HOURS
) -> DataFrame:
    """Estimated and recorded departures per weekday station-hour."""
    names = latest_station_info(info.select("station_id", "fetched_on", "short_name"), "short_name")
    estimated = (
        _weekday_demand(demand).groupBy("station_id").agg(F.avg("ebike_demand_per_hour").alias("est"))
    )
    recorded = (
        _weekday_ebike_trips(trips)
        .filter(F.col("start_station_id").isNotNull())
        .groupBy(F.col("start_station_id").alias("short_name"))
        .agg((F.count("*") / hours).alias("obs"))
    )
    return (
        names.join(estimated, "station_id")
        .join(recorded, "short_name")
        .select("station_id", "short_name", "est", "obs")
    )


def pearson(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("stations"), safe_corr("est", "obs").alias("pearson"))


def _ranked(pairs: DataFrame, descending: bool) -> DataFrame:
    """Both ranks of every station; ties share the lowest. ``pairs`` should be stored."""
    by_est = value_ranks(pairs, "est", "r_est", descending)
    by_obs = value_ranks(pairs, "obs", "r_obs", descending)
    return pairs.join(by_est, "est").join(by_obs, "obs")


def rank_corr(pairs: DataFrame) -> DataFrame:
    return _ranked(pairs, False).agg(safe_corr("r_est", "r_obs").alias("rank_corr"))


def top_rank_disagreement(pairs: DataFrame, top: int = 8, tolerance: int = 20) -> DataFrame:
    return (
        _ranked(pairs, True)
        .filter(F.col("r_est") <= top)
        .select(
            "short_name",
            F.col("r_est").alias("rank_grid"),
            F.col("r_obs").alias("rank_trips"),
            (F.abs(F.col("r_est") - F.col("r_obs")) > tolerance).alias("disagree"),
        )
        .orderBy("rank_grid", "short_name")
    )


def hourly_shape(demand: DataFrame, trips: DataFrame) -> DataFrame:
    """The day's profile from both sources, each relative to its own peak."""

    def profile(rows: DataFrame, hour: Column, value: Column, name: str) -> DataFrame:
        by_hour = rows.groupBy(hour.alias("hour")).agg(value.alias(name))
        peak = by_hour.agg(F.max(name)).scalar()
        return by_hour.withColumn(f"{name}_shape", F.try_divide(F.col(name), peak))

    est = profile(
        _weekday_demand(demand), F.col("hour"), F.avg("ebike_demand_per_hour"), "est"
    )
    obs = profile(
        _weekday_ebike_trips(trips), F.hour("started_at"), F.count("*").cast("double"), "obs"
    )
    return est.join(obs, "hour").orderBy("hour")


def shape_corr(shape: DataFrame) -> DataFrame:
    return shape.agg(safe_corr("est", "obs").alias("shape_corr"))
