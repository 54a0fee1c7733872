"""Small frames for the tests."""

from datetime import datetime, timedelta, timezone

from pedalgrid import schemas

T0 = datetime(2024, 3, 4, 12, 0, tzinfo=timezone.utc)  # a Monday, 04:00 in Los Angeles


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


def naive(ts: datetime) -> datetime:
    return ts.astimezone(timezone.utc).replace(tzinfo=None)


def status_frame(spark, rows):
    """rows of (station, minute, bikes, ebikes, docks) and optional overrides."""
    full = []
    for station, minute, bikes, ebikes, docks, *rest in rows:
        o = rest[0] if rest else {}
        full.append(
            (
                station,
                at(minute),
                at(minute),
                o.get("last_reported", at(minute - 1)),
                bikes,
                ebikes,
                o.get("disabled", 0),
                docks,
                0,
                o.get("installed", 1),
                o.get("renting", 1),
                o.get("returning", 1),
            )
        )
    return spark.createDataFrame(full, schemas.STATION_STATUS)


def poll_frame(spark, minutes, status="ok"):
    return spark.createDataFrame(
        [(at(m), status, None, None, None, None, None) for m in minutes], schemas.POLL_LOG
    )


def minute_of(ts: datetime) -> float:
    """Minutes since T0 of a collected (naive, machine zone) timestamp."""
    return (ts.astimezone(timezone.utc) - T0).total_seconds() / 60


GRID = (
    "bucket timestamp, station_id string, state_as_of timestamp, num_bikes_available smallint, "
    "num_ebikes_available smallint, classic_available smallint, num_bikes_disabled smallint, "
    "num_docks_available smallint, num_docks_disabled smallint, is_installed smallint, "
    "is_renting smallint, is_returning smallint, last_reported timestamp, is_stale boolean, "
    "is_serving boolean"
)


def grid_frame(spark, rows):
    """rows of (station, bucket number, bikes, ebikes, docks, serving)."""
    full = []
    for station, i, bikes, ebikes, docks, serving in rows:
        t = at(5 * i)
        classic = None if bikes is None or ebikes is None else bikes - ebikes
        full.append(
            (t, station, None if bikes is None else t, bikes, ebikes, classic, 0, docks, 0, 1, 1, 1, t, False, serving)
        )
    return spark.createDataFrame(full, GRID)


DEMAND = (
    "station_id string, daytype string, hour int, ebike_demand_per_hour double, "
    "ebike_availability double, low_confidence boolean"
)


def demand_frame(spark, stations, rate=1.0, low=False):
    rows = [
        (s, d, h, rate[s] if isinstance(rate, dict) else rate, 1.0, low)
        for s in stations
        for d in ("weekday", "weekend")
        for h in range(24)
    ]
    return spark.createDataFrame(rows, DEMAND)
