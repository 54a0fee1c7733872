"""Column helpers for instants, buckets and local clock time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pedalgrid.constants import BUCKET_MINUTES, LOCAL_ZONE

MINUTE = 60_000_000  # microseconds


def floor_bucket(ts: Column, minutes: int = BUCKET_MINUTES) -> Column:
    us = F.unix_micros(ts)
    return F.timestamp_micros(us - F.pmod(us, F.lit(minutes * MINUTE)))


def ceil_bucket(ts: Column, minutes: int = BUCKET_MINUTES) -> Column:
    us = F.unix_micros(ts)
    return F.timestamp_micros(us + F.pmod(-us, F.lit(minutes * MINUTE)))


def shift(ts: Column, minutes: float) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(int(minutes * MINUTE)))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000.0)


def bucket_range(first: Column, last: Column, minutes: int = BUCKET_MINUTES) -> Column:
    """Array of bucket starts from ``first`` to ``last``, both included."""
    return F.sequence(first, last, F.expr(f"interval {minutes} minutes"))


def epoch_to_ts(seconds: Column) -> Column:
    """Unix seconds to an instant; zero means "never" and becomes NULL."""
    return F.timestamp_seconds(F.nullif(seconds, F.lit(0)))


def local_hour(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.hour(F.from_utc_timestamp(ts, zone))


def is_weekend(local_ts: Column) -> Column:
    return F.dayofweek(local_ts).isin(1, 7)


def local_daytype(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.when(is_weekend(F.from_utc_timestamp(ts, zone)), "weekend").otherwise("weekday")


def with_local_clock(df, ts: str = "bucket", zone: str = LOCAL_ZONE):
    """Add ``daytype`` and ``hour``, the two time keys of a demand cell."""
    return df.withColumns(
        {"daytype": local_daytype(F.col(ts), zone), "hour": local_hour(F.col(ts), zone)}
    )
