"""The domain tables as views over the ``events`` table.

Sites are blocks of ten users; each event is one inventory change of its site. The
counts are arithmetic of the event's own numbers, so any engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pedalgrid.functions.ordered import slice_bounds, slice_of, sliced_row_number
from pedalgrid.functions.timeutil import shift

INFO_DAYS = (("2024-01-01", ""), ("2024-01-15", " (new)"))
RAW_REPEATS = 3
RAW_MINUTES = 2


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        "user_id",
        F.expr("user_id div 10").alias("sid"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _site_id() -> Column:
    return F.concat(F.lit("S"), F.col("sid").cast("string"))


def _small(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast("smallint")


def station_status(events: DataFrame) -> DataFrame:
    """The change log: (station_id, observed_at) and the inventory it saw."""
    us = F.unix_micros("ts")
    numbered = sliced_row_number(
        events.select("event_id", "ts", "sid", "k"),
        ["sid"],
        slice_of(us, slice_bounds(events, us)),
        [F.asc("ts"), F.asc("event_id")],
        name="n",
    )
    base = F.abs(F.pmod(F.col("n") * 3, F.lit(30)) - 15)
    counted = numbered.withColumn(
        "bikes", F.when(F.col("k") % 17 == 0, 15 - base).otherwise(base)
    )
    dry = (F.col("sid") % 7 == 3) & (F.col("k") >= 5)
    lost = F.when(F.col("event_id") % 23 == 0, 3).otherwise(0)
    late = F.when(F.col("event_id") % 31 == 0, shift(F.col("ts"), -120)).otherwise(
        shift(F.col("ts"), -1)
    )
    return counted.select(
        _site_id().alias("station_id"),
        F.col("ts").alias("observed_at"),
        F.col("ts").alias("feed_last_updated"),
        late.alias("last_reported"),
        _small(F.col("bikes")).alias("num_bikes_available"),
        _small(
            F.when(dry, 0).otherwise(F.greatest(F.col("bikes") - F.col("event_id") % 4, F.lit(0)))
        ).alias("num_ebikes_available"),
        _small(0).alias("num_bikes_disabled"),
        _small(F.greatest(15 - F.col("bikes") - lost, F.lit(0))).alias("num_docks_available"),
        _small(0).alias("num_docks_disabled"),
        _small(1).alias("is_installed"),
        _small(F.when(F.col("k") == 7, 0).otherwise(1)).alias("is_renting"),
        _small(F.when(F.col("k") == 9, 0).otherwise(1)).alias("is_returning"),
    )


def poll_log(events: DataFrame) -> DataFrame:
    failed = F.col("event_type") == "error"
    return events.select(
        F.col("ts").alias("polled_at"),
        F.when(failed, "error").otherwise("ok").alias("status"),
        F.when(failed, F.concat(F.lit("E"), F.col("k").cast("string"))).alias("error"),
    )


def station_info(events: DataFrame) -> DataFrame:
    """Two daily dimension snapshots; the second one renames every site."""
    days = F.explode(
        F.array(
            *(
                F.struct(F.lit(d).cast("date").alias("fetched_on"), F.lit(s).alias("suffix"))
                for d, s in INFO_DAYS
            )
        )
    )
    sid = F.col("sid")
    return (
        events.select("sid")
        .distinct()
        .select("sid", days.alias("day"))
        .select(
            _site_id().alias("station_id"),
            "day.fetched_on",
            F.concat(F.lit("Station "), sid.cast("string"), F.col("day.suffix")).alias("name"),
            F.concat(F.lit("SN"), sid.cast("string")).alias("short_name"),
            (F.lit(37.75) + F.lit(0.01) * (sid % 7)).alias("lat"),
            (F.lit(-122.45) + F.lit(0.03) * (sid % 11)).alias("lon"),
            (sid % 15).cast("string").alias("region_id"),
            F.lit(15).alias("capacity"),
        )
    )


def trips(events: DataFrame) -> DataFrame:
    """Departures in local clock time, with the month they are archived under."""
    started = shift(F.col("ts"), -8 * 60).cast("timestamp_ntz")
    return events.filter(F.col("event_type").isin("click", "purchase")).select(
        F.col("event_id").cast("string").alias("ride_id"),
        F.when(F.col("k") % 5 != 0, "electric_bike").otherwise("classic_bike").alias("rideable_type"),
        started.alias("started_at"),
        F.concat(F.lit("SN"), F.col("sid").cast("string")).alias("start_station_id"),
        F.date_format(started, "yyyyMM").alias("source_month"),
    )


def raw_series(status: DataFrame) -> DataFrame:
    """Every poll stored in full: each log row is seen again by the next two polls."""
    step = F.explode(F.sequence(F.lit(0), F.lit(RAW_REPEATS - 1)))
    return (
        status.withColumn("_i", step)
        .withColumn(
            "polled_at",
            F.timestamp_micros(
                F.unix_micros("observed_at") + F.col("_i") * (RAW_MINUTES * 60_000_000)
            ),
        )
        .drop("_i", "observed_at", "feed_last_updated")
    )


def vehicle_series(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").cast("string").alias("bike_id"),
        F.col("ts").alias("observed_at"),
        (F.lit(37.75) + F.lit(0.0001) * (F.col("k") % 5)).alias("lat"),
        (F.lit(-122.45) + F.lit(0.0001) * (F.col("k") % 3)).alias("lon"),
        (F.col("k") * 50).cast("double").alias("current_range_meters"),
        (F.col("event_id") % 13 == 0).cast("int").alias("is_disabled"),
        (F.col("event_id") % 17 == 0).cast("int").alias("is_reserved"),
    )
