"""Rider demand per station, day type and local hour, corrected for empty stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pedalgrid.constants import (
    BUCKETS_PER_HOUR,
    MIN_AVAILABILITY,
    MIN_EXPOSED_BUCKETS,
    RIDER_CHURN,
    SHRINK_BUCKETS,
)
from pedalgrid.functions.timeutil import with_local_clock

CELL = ["station_id", "daytype", "hour"]


def exposure(grid: DataFrame) -> DataFrame:
    """Whether a bike could be taken in a bucket: the row before had stock and was serving.

    Three-valued: an empty row before means no, whatever else is unknown about it.
    """
    w = W.partitionBy("station_id").orderBy("bucket")
    serving = F.lag("is_serving").over(w)
    return grid.filter(F.col("num_bikes_available").isNotNull()).select(
        "station_id",
        "bucket",
        ((F.lag("num_ebikes_available").over(w) > 0) & serving).alias("ebike_exposed"),
        ((F.lag("classic_available").over(w) > 0) & serving).alias("classic_exposed"),
    )


def rider_departures(exposed: DataFrame, deltas: DataFrame) -> DataFrame:
    """Bikes taken by riders in each bucket; van moves and artifacts count as none.

    Both tables are as long as the grid, so they are merged where they lie: a file that
    packs well must not pass for a small one and be broadcast.
    """

    def taken(change: str) -> Column:
        riders = (F.col("event_class") == RIDER_CHURN) & (F.col(change) < 0)
        return F.when(riders, -F.col(change)).otherwise(0)

    moves = deltas.select("station_id", "bucket", "event_class", "d_ebikes", "d_classic")
    return exposed.join(moves.hint("merge"), ["station_id", "bucket"], "left").select(
        *exposed.columns, taken("d_ebikes").alias("ebike_dep"), taken("d_classic").alias("classic_dep")
    )


def demand_observations(grid: DataFrame, deltas: DataFrame) -> DataFrame:
    return with_local_clock(rider_departures(exposure(grid), deltas))


def demand_cells(observations: DataFrame) -> DataFrame:
    """Buckets, stocked buckets and departures per cell; NULL departures if never stocked."""

    def seen(kind: str) -> list[Column]:
        exposed = F.col(f"{kind}_exposed")
        return [
            F.count_if(exposed).alias(f"{kind}_exposed_buckets"),
            F.sum(F.when(exposed, F.col(f"{kind}_dep"))).cast("bigint").alias(f"{kind}_obs"),
        ]

    return (
        observations.filter(F.col("ebike_exposed").isNotNull())
        .groupBy(*CELL)
        .agg(F.count("*").alias("total_buckets"), *seen("ebike"), *seen("classic"))
    )


def station_prior(cells: DataFrame) -> DataFrame:
    """The station's own departures per stocked bucket, over all its cells."""

    def rate(kind: str) -> Column:
        return F.try_divide(
            F.sum(f"{kind}_obs"), F.nullif(F.sum(f"{kind}_exposed_buckets"), F.lit(0))
        ).alias(f"{kind}_prior")

    return cells.groupBy("station_id").agg(rate("ebike"), rate("classic"))


def demand_baseline(
    cells: DataFrame,
    shrink: int = SHRINK_BUCKETS,
    min_availability: float = MIN_AVAILABILITY,
    min_exposed: int = MIN_EXPOSED_BUCKETS,
) -> DataFrame:
    """Demand per cell: stocked-time rates, pulled towards the station's own rate."""
    joined = cells.join(station_prior(cells), "station_id", "left")
    total = F.col("total_buckets")

    def pulled(kind: str) -> Column:
        return F.col(f"{kind}_obs") + shrink * F.coalesce(F.col(f"{kind}_prior"), F.lit(0.0))

    def weight(kind: str) -> Column:
        return F.col(f"{kind}_exposed_buckets") + shrink

    def availability(kind: str) -> Column:
        return F.col(f"{kind}_exposed_buckets") / total

    return joined.select(
        *CELL,
        "total_buckets",
        "ebike_exposed_buckets",
        "ebike_obs",
        availability("ebike").alias("ebike_availability"),
        availability("classic").alias("classic_availability"),
        (pulled("ebike") / weight("ebike")).alias("ebike_rate_per_bucket"),
        (pulled("classic") / weight("classic")).alias("classic_rate_per_bucket"),
        (BUCKETS_PER_HOUR * pulled("ebike") / weight("ebike")).alias("ebike_demand_per_hour"),
        (total * pulled("ebike") / weight("ebike")).alias("ebike_latent_total"),
        F.col("ebike_obs").alias("ebike_observed_total"),
        (
            (availability("ebike") < min_availability)
            | (F.col("ebike_exposed_buckets") < min_exposed)
        ).alias("low_confidence"),
    )


def demand_summary(demand: DataFrame) -> DataFrame:
    """Network totals: cells, observed and estimated departures, and the hidden part."""
    sure = ~F.col("low_confidence")
    totals = demand.agg(
        F.count("*").alias("cells"),
        F.count_distinct("station_id").alias("stations"),
        F.count_if("low_confidence").alias("low_confidence_cells"),
        F.sum(F.when(sure, F.col("ebike_observed_total"))).alias("observed"),
        F.sum(F.when(sure, F.col("ebike_latent_total"))).alias("latent"),
    )
    return totals.withColumns(
        {
            "low_confidence_share": F.try_divide("low_confidence_cells", "cells"),
            "hidden": F.col("latent") - F.col("observed"),
            "hidden_ratio": F.try_divide("latent", "observed") - 1,
        }
    )


def demand_hourly_profile(demand: DataFrame, daytype: str = "weekday") -> DataFrame:
    return (
        demand.filter((F.col("daytype") == daytype) & ~F.col("low_confidence"))
        .groupBy("hour")
        .agg(
            F.avg("ebike_demand_per_hour").alias("demand_per_hour"),
            F.avg("ebike_availability").alias("availability"),
        )
        .orderBy("hour")
    )


def with_demand(grid: DataFrame, demand: DataFrame, how: str = "inner") -> DataFrame:
    """Grid rows that have a state, with the demand of their cell.

    No hint: the stored demand table is broadcast when its files are small, and joined
    on the grid's own station partitioning when they are not.
    """
    cells = demand.select(*CELL, "ebike_demand_per_hour", "low_confidence")
    stocked = grid.filter(F.col("num_bikes_available").isNotNull())
    return with_local_clock(stocked).join(cells, CELL, how)
