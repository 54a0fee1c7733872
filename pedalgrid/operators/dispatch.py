"""Which stations lack e-bikes at each decision epoch, which could give some, and how near they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pedalgrid.constants import (
    BUCKET_MINUTES,
    DISPATCH_WINDOW_MINUTES,
    EPOCH_MINUTES,
    HANDLING_MINUTES,
    SHIFT_MINUTES,
    VAN_SPEED_KMH,
)
from pedalgrid.functions.geo import haversine, sphere_cell, touching_cells
from pedalgrid.functions.ordered import slice_bounds, slice_of, sliced_row_number
from pedalgrid.operators.deltas import latest_station_info
from pedalgrid.operators.demand import with_demand
from pedalgrid.operators.forecast import split_point
from pedalgrid.session import cut_lineage, recent

MIN_EXPECTED = 0.05
MIN_SHORT = 0.5
MIN_SURPLUS = 3
REACH_KM = (SHIFT_MINUTES - HANDLING_MINUTES) / 60 * VAN_SPEED_KMH
SEARCH_KM = (1.0, 4.0)


def decision_rows(grid: DataFrame, demand: DataFrame) -> DataFrame:
    """Serving stations with a confident demand in the later part of the grid."""
    later = recent(grid, "bucket", split_point(grid).scalar())
    rows = with_demand(later, demand).filter(F.col("is_serving") & ~F.col("low_confidence"))
    return rows.select(
        "bucket",
        "station_id",
        F.coalesce("num_ebikes_available", F.lit(0)).alias("ebikes"),
        F.coalesce("ebike_demand_per_hour", F.lit(0.0)).alias("demand"),
    )


def decision_epochs(rows: DataFrame, every_minutes: int = EPOCH_MINUTES) -> DataFrame:
    """Every sixth bucket that occurs. The list of distinct buckets is bounded by time."""
    step = every_minutes // BUCKET_MINUTES
    position = F.row_number().over(W.orderBy("bucket")) - 1
    return (
        rows.select("bucket")
        .distinct()
        .withColumn("epoch", position)
        .filter(F.col("epoch") % step == 0)
        .withColumn("epoch", (F.col("epoch") / step).cast("int"))
    )


def deficits_donors(
    rows: DataFrame, epochs: DataFrame, window_minutes: int = DISPATCH_WINDOW_MINUTES
) -> DataFrame:
    """Stations short of the coming demand, and stations with stock to give, per epoch.

    ``epochs`` has one row per half hour of the later part, so it is small by nature.
    """
    expected = F.col("demand") * (window_minutes / 60.0)
    here = rows.join(F.broadcast(epochs.select("bucket")), "bucket", "left_semi")
    sized = here.withColumn("expected", expected).filter(F.col("expected") > MIN_EXPECTED)
    short = F.col("expected") - F.col("ebikes")
    surplus = F.col("ebikes") - F.col("expected")
    kind = F.when(short > MIN_SHORT, "deficit").when(surplus >= MIN_SURPLUS, "donor")
    size = F.when(F.col("kind") == "deficit", short).otherwise(
        F.least(surplus, F.col("ebikes") - 1.0)
    )
    return (
        sized.withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .select("bucket", "station_id", "kind", size.alias("size"), "expected")
    )


def rank_deficits_donors(sized: DataFrame) -> DataFrame:
    """Largest first within (epoch, kind); equal sizes in station order."""
    cut = slice_of(F.col("size"), slice_bounds(sized, F.col("size")))
    return sliced_row_number(
        sized,
        ["bucket", "kind"],
        cut,
        [F.desc("size"), F.asc("station_id")],
        name="rank",
        descending=True,
    )


def minutes_for(km):
    return km / VAN_SPEED_KMH * 60 + HANDLING_MINUTES


def placed(sized: DataFrame, info: DataFrame) -> DataFrame:
    spots = latest_station_info(info.select("station_id", "fetched_on", "lat", "lon"), "lat")
    return sized.join(spots.select("station_id", "lat", "lon"), "station_id")


def _within(spots: DataFrame, donors: DataFrame, km: float) -> DataFrame:
    """Pairs (spot, donor) of one epoch at most ``km`` apart, by an equi join on cells."""
    home = spots.withColumn("home", sphere_cell(F.col("lat"), F.col("lon"), km))
    near = home.withColumn("cell", F.explode(touching_cells("home"))).drop("home")
    held = donors.withColumnsRenamed({"lat": "d_lat", "lon": "d_lon"}).withColumn(
        "cell", sphere_cell(F.col("d_lat"), F.col("d_lon"), km)
    )
    pairs = near.join(held, ["bucket", "cell"]).drop("cell")
    away = haversine(F.col("lat"), F.col("lon"), F.col("d_lat"), F.col("d_lon"))
    return pairs.withColumn("km", away).filter(F.col("km") <= km).drop("d_lat", "d_lon")


def nearest_donor(located: DataFrame, reach_km: float = REACH_KM) -> DataFrame:
    """Per deficit the closest donor a van can serve within its shift, if there is one.

    Stations at one spot share the answer, and of the donors at one spot only the largest
    can win. The search widens its cells step by step and only spots still without a donor
    go on, so a dense city is settled by its close neighbours.
    """
    spot = ["bucket", "lat", "lon"]
    donors = cut_lineage(
        located.filter((F.col("kind") == "donor") & (F.col("size") >= 1))
        .groupBy(*spot)
        .agg(F.min(F.struct((-F.col("size")).alias("less"), "station_id")).alias("best"))
        .select(*spot, "best.less", F.col("best.station_id").alias("donor_id")),
        "donors",
    )
    deficits = cut_lineage(located.filter(F.col("kind") == "deficit"), "deficits")
    waiting = cut_lineage(deficits.select(*spot).distinct(), "waiting")
    found = None
    for km in [k for k in SEARCH_KM if k < reach_km] + [reach_km]:
        hits = (
            _within(waiting, donors, km)
            .groupBy(*spot)
            .agg(F.min(F.struct("km", "less", "donor_id")).alias("hit"))
        )
        hits = cut_lineage(hits.select(*spot, "hit.km", "hit.donor_id"), "hits")
        found = hits if found is None else found.unionByName(hits)
        waiting = cut_lineage(waiting.join(hits, spot, "left_anti"), "waiting")
        if waiting.isEmpty():
            break
    return deficits.join(found, spot).select(
        "bucket",
        "station_id",
        F.col("size").alias("short"),
        "donor_id",
        "km",
        minutes_for(F.col("km")).alias("minutes"),
    )
