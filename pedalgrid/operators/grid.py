"""The dense observation grid: one row per covered bucket and station."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pedalgrid.constants import (
    BUCKET_MINUTES,
    COVERAGE_CAP_MINUTES,
    STALE_AFTER_SECONDS,
    STATE_FIELDS,
)
from pedalgrid.functions.picking import latest_per
from pedalgrid.functions.timeutil import (
    bucket_range,
    ceil_bucket,
    floor_bucket,
    seconds_between,
    shift,
)
from pedalgrid.session import shuffle_width

# The age bins and their names.
AGE_BINS = (
    ("same bucket", 0, 300),
    ("5-15 min", 300, 900),
    ("15-60 min", 900, 3600),
    ("> 1 hour", 3600, 10**9),
)


def bucket_spine(polls: DataFrame, minutes: int = BUCKET_MINUTES) -> DataFrame:
    """Every bucket from the one of the first good poll up to the last good poll."""
    span = polls.filter(F.col("status") == "ok").agg(
        F.min("polled_at").alias("first"), F.max("polled_at").alias("last")
    )
    span = span.filter(F.col("first").isNotNull())
    starts = bucket_range(
        floor_bucket(F.col("first"), minutes), floor_bucket(F.col("last"), minutes), minutes
    )
    return span.select(F.explode(starts).alias("bucket"))


def bucket_coverage(
    polls: DataFrame, minutes: int = BUCKET_MINUTES, cap: int = COVERAGE_CAP_MINUTES
) -> DataFrame:
    """Buckets with a good poll at most ``cap`` minutes away, within the polled span.

    The reach of polls in one slot is one unbroken interval as long as a slot is no wider
    than twice the cap, so the log shrinks to two instants per slot before it fans out.
    """
    slots = (
        polls.filter(F.col("status") == "ok")
        .groupBy(floor_bucket(F.col("polled_at"), minutes).alias("slot"))
        .agg(F.min("polled_at").alias("first"), F.max("polled_at").alias("last"))
    )
    span = slots.agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    reach = bucket_range(
        ceil_bucket(shift(F.col("first"), -cap), minutes),
        floor_bucket(shift(F.col("last"), cap), minutes),
        minutes,
    )
    return (
        slots.select(F.explode(reach).alias("bucket"))
        .distinct()
        .filter(
            F.col("bucket").between(span.select("lo").scalar(), span.select("hi").scalar())
        )
    )


def station_spine(status: DataFrame) -> DataFrame:
    return status.select("station_id").distinct()


#: Rows of the dense grid that one task holds and sorts, about.
TASK_ROWS = 1_000_000


def grid_width(status: DataFrame, covered: DataFrame, task_rows: int = TASK_ROWS) -> int:
    """Over how many tasks the dense grid is dealt: more with more stations and buckets, so that a task's part stays."""
    rows = station_spine(status).count() * covered.count()
    return max(shuffle_width(status.sparkSession), math.ceil(rows / task_rows))


def _wide(rows: DataFrame, width: int | None = None) -> DataFrame:
    """Stations over all tasks, also where few bytes are about to become many rows."""
    return rows.repartition(width or shuffle_width(rows.sparkSession), "station_id")


def _segments(status: DataFrame, covered: DataFrame, minutes: int, width: int | None = None) -> DataFrame:
    """Per station, the unbroken run of buckets for which one log row is the latest.

    The log first shrinks to the last row per (station, bucket it takes effect in), so a
    station that reports a lot has no more rows than there are buckets.
    """
    span = covered.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    state = ["observed_at", "last_reported", *STATE_FIELDS]
    log = status.select("station_id", *state).withColumns({"lo": lo, "hi": hi})
    begin = F.least(
        F.greatest(ceil_bucket(F.col("observed_at"), minutes), F.col("lo")),
        shift(F.col("hi"), minutes),
    )
    steps = latest_per(
        log.withColumn("effective", begin).drop("lo", "hi"),
        ["station_id", "effective"],
        "observed_at",
    ).withColumns({"lo": lo, "hi": hi})
    by_station = W.partitionBy("station_id").orderBy("effective")
    runs = _wide(steps, width).withColumns(
        {
            "first_bucket": F.when(
                F.row_number().over(by_station) == 1, F.col("lo")
            ).otherwise(F.col("effective")),
            "last_bucket": F.least(
                F.col("hi"),
                F.coalesce(
                    shift(F.lead("effective").over(by_station), -minutes), F.col("hi")
                ),
            ),
        }
    )
    return runs.filter(F.col("first_bucket") <= F.col("last_bucket"))


def grid_spine(status: DataFrame, covered: DataFrame, minutes: int = BUCKET_MINUTES) -> DataFrame:
    """Covered buckets of every station, without state."""
    span = covered.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    stations = station_spine(status).withColumns(
        {"lo": span.select("lo").scalar(), "hi": span.select("hi").scalar()}
    )
    dense = _wide(stations.filter(F.col("lo").isNotNull())).select(
        "station_id", F.explode(bucket_range(F.col("lo"), F.col("hi"), minutes)).alias("bucket")
    )
    return dense.join(covered, "bucket", "left_semi").select("bucket", "station_id")


def grid_status(
    status: DataFrame,
    covered: DataFrame,
    minutes: int = BUCKET_MINUTES,
    stale_after: int = STALE_AFTER_SECONDS,
    width: int | None = None,
) -> DataFrame:
    """For every covered bucket and station, the latest state seen at the bucket's start.

    Buckets before a station's first row stay, with NULL state. Whether a bucket is known
    at all depends on polling (``covered``), never on the age of the row.
    """
    runs = _segments(status, covered, minutes, width)
    dense = runs.withColumn(
        "bucket", F.explode(bucket_range(F.col("first_bucket"), F.col("last_bucket"), minutes))
    ).join(covered, "bucket", "left_semi")
    seen = F.col("bucket") >= F.col("effective")
    held = dense.select(
        "bucket",
        "station_id",
        F.when(seen, F.col("observed_at")).alias("state_as_of"),
        F.when(seen, F.col("last_reported")).alias("last_reported"),
        *(F.when(seen, F.col(f)).alias(f) for f in STATE_FIELDS),
    )
    return grid_flags(held, stale_after)


def grid_flags(held: DataFrame, stale_after: int = STALE_AFTER_SECONDS) -> DataFrame:
    """Add classic stock, staleness at observation time and the three-valued serving flag."""
    stale = seconds_between(F.col("last_reported"), F.col("state_as_of")) > stale_after
    return held.select(
        "bucket",
        "station_id",
        "state_as_of",
        "num_bikes_available",
        "num_ebikes_available",
        (F.col("num_bikes_available") - F.col("num_ebikes_available")).alias("classic_available"),
        "num_bikes_disabled",
        "num_docks_available",
        "num_docks_disabled",
        "is_installed",
        "is_renting",
        "is_returning",
        "last_reported",
        stale.alias("is_stale"),
        ((F.col("is_installed") == 1) & (F.col("is_renting") == 1) & ~stale).alias("is_serving"),
    )


def fill_age_histogram(grid: DataFrame, bins=AGE_BINS) -> DataFrame:
    """How old the carried state is: count and share of all grid rows per age bin."""
    age = seconds_between(F.col("state_as_of"), F.col("bucket"))
    one = grid.agg(
        F.count("*").alias("total"),
        *(F.count_if((age >= lo) & (age < hi)).alias(f"b{i}") for i, (_, lo, hi) in enumerate(bins)),
    )
    rows = F.explode(
        F.array(
            *(
                F.struct(F.lit(label).alias("age_bin"), F.col(f"b{i}").alias("cells"))
                for i, (label, _, _) in enumerate(bins)
            )
        )
    )
    return one.select("total", rows.alias("r")).select(
        "r.age_bin", "r.cells", F.try_divide("r.cells", "total").alias("share")
    )


def grid_summary(grid: DataFrame) -> DataFrame:
    """Counted per station first; the list of distinct buckets is bounded by time."""
    per_station = grid.groupBy("station_id").agg(
        F.count("*").alias("cells"),
        F.count_if(F.col("num_bikes_available").isNull()).alias("unknown"),
        F.min("bucket").alias("first"),
        F.max("bucket").alias("last"),
    )
    buckets = grid.select("bucket").distinct().agg(F.count("bucket")).scalar()
    return per_station.agg(
        F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"),
        F.count("station_id").alias("stations"),
        F.coalesce(F.sum("unknown"), F.lit(0)).alias("null_state"),
        F.date_format(F.min("first"), "yyyy-MM-dd HH:mm").alias("first_bucket"),
        F.date_format(F.max("last"), "yyyy-MM-dd HH:mm").alias("last_bucket"),
    ).select("cells", buckets.alias("buckets"), "stations", "null_state", "first_bucket", "last_bucket")
