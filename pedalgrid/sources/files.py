"""File sources: trip archives as CSV, feed snapshots as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedalgrid import schemas
from pedalgrid.constants import STATE_FIELDS
from pedalgrid.functions.timeutil import epoch_to_ts

TRIP_CLOCK = "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]"
#: Rows in a snapshot document that is written here.
SNAPSHOT_ROWS = 1 << 14


def scan_trips_csv(spark: SparkSession, path: str) -> DataFrame:
    """Trip rows with declared types; ids stay text and clock times carry no zone."""
    return (
        spark.read.schema(schemas.TRIPS)
        .option("header", True)
        .option("timestampNTZFormat", TRIP_CLOCK)
        .csv(path)
    )


def snapshot_rows(docs: DataFrame, polled_at: str | None = None) -> DataFrame:
    """One row per station of each snapshot document, batch or stream."""
    stations = docs.select(
        *([F.col(polled_at).alias("polled_at")] if polled_at else []),
        epoch_to_ts(F.col("last_updated")).alias("feed_last_updated"),
        F.explode("data.stations").alias("s"),
    )
    return stations.select(
        *(["polled_at"] if polled_at else []),
        "s.station_id",
        "feed_last_updated",
        epoch_to_ts(F.col("s.last_reported")).alias("last_reported"),
        *(f"s.{f}" for f in STATE_FIELDS),
    )


def snapshot_documents(status: DataFrame, most: int = SNAPSHOT_ROWS) -> DataFrame:
    """Snapshot documents by hour, each of at most ``most`` rows that lie beside each other in ``status``; an hour has
    as many documents as it needs. ``status`` should be a stored table, so that its rows keep their places."""
    station = F.struct(
        "station_id", F.unix_seconds("last_reported").alias("last_reported"), *STATE_FIELDS
    )
    hour = F.unix_seconds(F.date_trunc("hour", "observed_at")).alias("last_updated")
    placed = status.withColumn("_part", F.floor(F.monotonically_increasing_id() / most))
    return (
        placed.groupBy(hour, "_part")
        .agg(F.struct(F.collect_list(station).alias("stations")).alias("data"))
        .drop("_part")
    )


def scan_snapshot_json(spark: SparkSession, path: str) -> DataFrame:
    return snapshot_rows(spark.read.schema(schemas.SNAPSHOT).json(path))


def stream_snapshot_json(
    spark: SparkSession, path: str, max_files_per_trigger: int = 1000
) -> DataFrame:
    """The same rows as a stream over a folder that receives one document per poll."""
    docs = (
        spark.readStream.schema(schemas.SNAPSHOT)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .json(path)
    )
    return snapshot_rows(docs)
