"""Declared schemas of the input tables (no inference anywhere)."""

STATE = (
    "num_bikes_available smallint, num_ebikes_available smallint, num_bikes_disabled smallint, "
    "num_docks_available smallint, num_docks_disabled smallint, is_installed smallint, "
    "is_renting smallint, is_returning smallint"
)

STATION_STATUS = (
    "station_id string, observed_at timestamp, feed_last_updated timestamp, "
    f"last_reported timestamp, {STATE}"
)

STATION_INFO = (
    "station_id string, fetched_on date, name string, short_name string, lat double, lon double, "
    "region_id string, capacity int, address string"
)

POLL_LOG = (
    "polled_at timestamp, status string, feed_last_updated timestamp, stations_seen int, "
    "rows_written int, duration_ms int, error string"
)

TRIPS = (
    "ride_id string, rideable_type string, started_at timestamp_ntz, ended_at timestamp_ntz, "
    "start_station_name string, start_station_id string, end_station_name string, "
    "end_station_id string, start_lat double, start_lng double, end_lat double, end_lng double, "
    "member_casual string"
)

# one poll of the status feed
SNAPSHOT = (
    "last_updated bigint, data struct<stations: array<struct<station_id: string, "
    "last_reported: bigint, num_bikes_available: smallint, num_ebikes_available: smallint, "
    "num_bikes_disabled: smallint, num_docks_available: smallint, num_docks_disabled: smallint, "
    "is_installed: smallint, is_renting: smallint, is_returning: smallint>>>"
)
