"""Compact frames of the last week for display."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pedalgrid.constants import (
    EBIKE_CAP,
    EXPORT_DAYS,
    FRAME_STRIDE,
    PULSE_FRAMES,
    RUNWAY_DOOMED_MINUTES,
    RUNWAY_WATCH_MINUTES,
)
from pedalgrid.functions.ordered import global_index
from pedalgrid.operators.deltas import is_van, latest_station_info
from pedalgrid.operators.demand import with_demand
from pedalgrid.session import recent

# Zone numbers, their regions and borders, and the one-character state codes.
ZONE_NAMES = ("San Francisco", "East Bay", "San Jose")
EAST_BAY_REGIONS = ("12", "13", "14")
SAN_JOSE_REGION = "5"
EAST_BAY_LON, EAST_BAY_LAT, SAN_JOSE_LAT = -122.35, 37.7, 37.5
ABSENT = "9"

SERIES = ("bikes", "ebikes", "starved", "empty", "full", "short", "doomed", "watch")
CODES = ("state", "demand_state", "runway_state")
CHUNK = 1024


def service_zone(region: Column, lat: Column, lon: Column) -> Column:
    east = (lon > EAST_BAY_LON) & (lat > EAST_BAY_LAT)
    return (
        F.when(region.isin(*EAST_BAY_REGIONS) | east, 1)
        .when((region == SAN_JOSE_REGION) | (lat < SAN_JOSE_LAT), 2)
        .otherwise(0)
    )


def station_list(info: DataFrame) -> DataFrame:
    """Stations with a position, numbered from 0 in id order, as the page shows them."""
    cols = ["station_id", "fetched_on", "name", "lat", "lon", "capacity", "region_id"]
    newest = latest_station_info(info.select(*cols), "lat")
    return global_index(newest, ["station_id"]).select(
        "idx",
        "station_id",
        F.col("name").alias("n"),
        F.round("lat", 5).alias("la"),
        F.round("lon", 5).alias("lo"),
        F.col("capacity").alias("c"),
        service_zone(F.col("region_id"), F.col("lat"), F.col("lon")).alias("z"),
    )


def window_buckets(grid: DataFrame, days: int = EXPORT_DAYS, stride: int = FRAME_STRIDE) -> DataFrame:
    """Buckets of the last ``days`` in order; every ``stride``-th one is a frame.

    At most one row per five minutes of the window, so one task may number them.
    """
    known = grid.filter(F.col("num_bikes_available").isNotNull())
    newest = known.agg(F.max("bucket").alias("b"))
    since = newest.select(
        F.timestamp_micros(F.unix_micros("b") - days * 86_400_000_000)
    ).scalar()
    position = F.row_number().over(W.orderBy("bucket")) - 1
    return (
        recent(known, "bucket", since)
        .select("bucket")
        .distinct()
        .withColumn("position", position)
        .withColumn(
            "frame",
            F.when(F.col("position") % stride == 0, (F.col("position") / stride).cast("int")),
        )
    )


def export_window(buckets: DataFrame) -> DataFrame:
    return buckets.filter(F.col("frame").isNotNull()).select("frame", "bucket")


def state_code() -> Column:
    return (
        F.when(~F.coalesce("is_serving", F.lit(False)), "4")
        .when(F.col("num_bikes_available") == 0, "2")
        .when(F.col("num_ebikes_available") == 0, "1")
        .when(F.col("num_docks_available") == 0, "3")
        .otherwise("0")
    )


def _insufficient() -> Column:
    return (
        F.coalesce("is_serving", F.lit(False))
        & ~F.col("lowconf")
        & (F.col("e") > 0)
        & (F.col("e") < F.col("demand"))
    )


def demand_code() -> Column:
    return (
        F.when(~F.coalesce("is_serving", F.lit(False)), "4")
        .when((F.col("e") == 0) & (F.col("demand") > 0.1), "1")
        .when(_insufficient(), "5")
        .otherwise("0")
    )


def runway_code() -> Column:
    minutes = F.try_divide("e", "demand") * 60
    return (
        F.when(~F.coalesce("is_serving", F.lit(False)), "4")
        .when(F.col("lowconf") | (F.col("demand") <= 0.05), "0")
        .when(F.col("e") == 0, "3")
        .when(minutes < RUNWAY_DOOMED_MINUTES, "2")
        .when(minutes < RUNWAY_WATCH_MINUTES, "1")
        .otherwise("0")
    )


def frame_cells(
    grid: DataFrame, demand: DataFrame, buckets: DataFrame, stations: DataFrame
) -> DataFrame:
    """Coded grid rows of the retained frames; ``idx`` is NULL for a station without position.

    ``buckets`` spans a fixed number of days, so it is small whatever the grid holds.
    """
    frames = export_window(buckets)
    since = frames.agg(F.min("bucket")).scalar()
    shown = recent(grid, "bucket", since).join(F.broadcast(frames), "bucket")
    rows = (
        with_demand(shown, demand, "left")
        .join(stations.select("station_id", "idx"), "station_id", "left")
        .withColumns(
            {
                "demand": F.coalesce("ebike_demand_per_hour", F.lit(0.0)),
                "lowconf": F.coalesce("low_confidence", F.lit(True)),
                "e": F.coalesce("num_ebikes_available", F.lit(0)),
            }
        )
    )
    return rows.select(
        "frame",
        "bucket",
        "station_id",
        "idx",
        F.col("num_bikes_available").alias("bikes"),
        F.col("num_ebikes_available").alias("ebikes"),
        F.col("num_docks_available").alias("docks"),
        "is_serving",
        "is_returning",
        "e",
        state_code().alias("state"),
        demand_code().alias("demand_state"),
        runway_code().alias("runway_state"),
        _insufficient().alias("insufficient"),
    )


def fleet_series(cells: DataFrame) -> DataFrame:
    """Network totals per frame; the runway counts need a known position."""

    def serving_without(what: str) -> Column:
        return F.count_if((F.col(what) == 0) & F.col("is_serving"))

    def runway(code: str) -> Column:
        return F.count_if((F.col("runway_state") == code) & F.col("idx").isNotNull())

    return (
        cells.groupBy("frame", "bucket")
        .agg(
            F.sum("bikes").alias("bikes"),
            F.sum("e").alias("ebikes"),
            serving_without("ebikes").alias("starved"),
            serving_without("bikes").alias("empty"),
            F.count_if((F.col("docks") == 0) & (F.col("is_returning") == 1)).alias("full"),
            F.count_if("insufficient").alias("short"),
            runway("2").alias("doomed"),
            runway("1").alias("watch"),
        )
        .select("frame", F.col("bucket").alias("t"), *SERIES)
    )


def _frame_chunks(cells: DataFrame, frames: DataFrame, n: Column, chunk: int) -> DataFrame:
    """Per frame and run of ``chunk`` stations: the code strings and the e-bike counts.

    Every station has a place in every frame, whether or not it was seen.
    """
    known = cells.filter(F.col("idx").isNotNull()).select(
        "frame", F.col("idx").cast("bigint").alias("idx"), *CODES, F.least("e", F.lit(EBIKE_CAP)).alias("e")
    )
    every = frames.withColumn("_n", n).filter(F.col("_n") > 0)
    places = every.select("frame", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("idx"))
    full = places.join(known, ["frame", "idx"], "left")
    value = F.struct("idx", *(F.coalesce(c, F.lit(ABSENT)).alias(c) for c in CODES), F.coalesce("e", F.lit(0)).alias("e"))
    packed = full.groupBy("frame", F.floor(F.col("idx") / chunk).alias("part")).agg(
        F.array_sort(F.collect_list(value)).alias("at")
    )
    return packed.select(
        "frame",
        "part",
        *(F.array_join(F.col(f"at.{c}"), "").alias(c) for c in CODES),
        F.col("at.e").alias("ebikes"),
    )


def frame_rows(cells: DataFrame, stations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per frame: a character per station and kind, and the capped e-bike counts.

    Codes are joined to strings per ``chunk`` stations first, so what meets in one task is
    a few long strings rather than a row per station. A frame in which no station with a
    position was seen has all its places absent.
    """
    frames = cells.select("frame").distinct()
    parts = _frame_chunks(cells, frames, stations.agg(F.count("*")).scalar(), chunk)
    whole = parts.groupBy("frame").agg(
        F.array_sort(F.collect_list(F.struct("part", *CODES, "ebikes"))).alias("at")
    )
    joined = frames.join(whole, "frame", "left")
    return joined.select(
        "frame",
        *(F.coalesce(F.array_join(F.col(f"at.{c}"), ""), F.lit("")).alias(c) for c in CODES),
        F.coalesce(F.flatten("at.ebikes"), F.array().cast("array<int>")).alias("ebikes"),
    )


def van_nearest_frame(deltas: DataFrame, buckets: DataFrame, stations: DataFrame) -> DataFrame:
    """Van events of the window on their nearest frame; halfway goes to the later one.

    Only the few thousand buckets of the window are ordered; events then join them by time.
    """
    in_time = W.orderBy("bucket")
    before = F.last("frame", ignorenulls=True).over(in_time.rowsBetween(W.unboundedPreceding, 0))
    before_at = F.last(F.when(F.col("frame").isNotNull(), F.col("bucket")), ignorenulls=True).over(
        in_time.rowsBetween(W.unboundedPreceding, 0)
    )
    after = F.first("frame", ignorenulls=True).over(in_time.rowsBetween(0, W.unboundedFollowing))
    after_at = F.first(F.when(F.col("frame").isNotNull(), F.col("bucket")), ignorenulls=True).over(
        in_time.rowsBetween(0, W.unboundedFollowing)
    )
    here = F.unix_micros("bucket")
    slots = buckets.select(
        "bucket",
        before.alias("before"),
        after.alias("after"),
        (here - F.unix_micros(before_at)).alias("back"),
        (F.unix_micros(after_at) - here).alias("ahead"),
    ).filter(F.col("after").isNotNull())
    frame = F.when(F.col("back") < F.col("ahead"), F.col("before")).otherwise(F.col("after"))
    since = buckets.agg(F.min("bucket")).scalar()
    events = deltas.filter(is_van() & (F.col("bucket") >= since))
    return (
        events.join(F.broadcast(slots.select("bucket", frame.alias("frame"))), "bucket")
        .join(stations.select("station_id", "idx"), "station_id")
        .select("frame", "idx", F.col("d_bikes").cast("int").alias("d_bikes"), "bucket")
    )


def bucketed_events(vans: DataFrame, buckets: DataFrame, pulse: int = PULSE_FRAMES) -> DataFrame:
    """For every frame, the van events it still shows and how many frames old they are."""
    last = export_window(buckets).agg(F.max("frame")).scalar()
    return (
        vans.withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(pulse))))
        .withColumn("shown_in", F.col("frame") + F.col("age"))
        .filter(F.col("shown_in") <= last)
        .select(F.col("shown_in").alias("frame"), "age", "idx", "d_bikes")
    )


def export_document(
    stations: DataFrame, series: DataFrame, frames: DataFrame, vans: DataFrame
) -> DataFrame:
    """The display document as JSON lines: one per zone, station, frame and van event.

    :func:`write_document` gives files that load line by line, so no task ever holds the whole.
    """
    station = stations.select(
        F.lit("station").alias("part"),
        F.col("idx").cast("bigint").alias("seq"),
        F.to_json(F.struct("n", "la", "lo", "c", "z")).alias("doc"),
    )
    zulu = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("t")
    frame = series.join(frames.withColumnRenamed("ebikes", "counts"), "frame").select(
        F.lit("frame").alias("part"),
        F.col("frame").cast("bigint").alias("seq"),
        F.to_json(
            F.struct(
                F.struct(zulu, *SERIES).alias("series"),
                F.col("state").alias("frame"),
                F.col("demand_state").alias("dframe"),
                F.col("runway_state").alias("rframe"),
                F.col("counts").alias("ebikes"),
            )
        ).alias("doc"),
    )
    van = vans.select(
        F.lit("van").alias("part"),
        F.col("frame").cast("bigint").alias("seq"),
        F.to_json(F.array(F.col("frame").cast("int"), F.col("idx").cast("int"), "d_bikes")).alias("doc"),
    )
    names = [(i, json.dumps(name)) for i, name in enumerate(ZONE_NAMES)]
    zone = stations.sparkSession.createDataFrame(names, "seq bigint, doc string")
    zone = zone.select(F.lit("zone").alias("part"), "seq", "doc")
    return zone.unionByName(station).unionByName(frame).unionByName(van)


def write_document(document: DataFrame, path: str) -> None:
    """Store the document as JSON lines, one folder per part."""
    line = F.to_json(F.struct("seq", "doc")).alias("line")
    document.select("part", line).write.partitionBy("part").text(path)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.schema("value string, part string").text(path)
    line = F.from_json("value", "seq bigint, doc string").alias("l")
    return lines.select("part", line).select("part", "l.seq", "l.doc")
