"""Every operator as a named query over one input folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pedalgrid.constants import LOCAL_ZONE, STATE_FIELDS, VAN_MIN_BIKES
from pedalgrid.functions import timeutil
from pedalgrid.functions.geo import haversine
from pedalgrid.functions.poisson import surprise_threshold
from pedalgrid.operators import (
    audit,
    calibrate,
    cdc,
    deltas,
    demand,
    dispatch,
    export,
    forecast,
    freshness,
    grid,
    health,
    outages,
    validate,
)
from pedalgrid.plans.fleet import Fleet, fleet, plain, rounded
from pedalgrid.session import fresh_path, shuffle_width
from pedalgrid.sources import files, tables
from pedalgrid.streaming import jobs, keyed, poll

QUERIES: dict[str, Callable[[Fleet], DataFrame]] = {}

MIDDLE = "2024-01-16"
MICRO_BATCH_ROWS, MICRO_BATCH_FILES = 5_000_000, 256
AFTER_ALL = datetime(2100, 1, 1, tzinfo=timezone.utc)


def query(fn: Callable[[Fleet], DataFrame]) -> Callable[[Fleet], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: plain(rounded(fn(fleet(spark, sf_dir))))

    return {name: bind(fn) for name, fn in QUERIES.items()}


def _before(df: DataFrame, day: str, col: str = "observed_at") -> DataFrame:
    return df.filter(F.col(col) < F.lit(day).cast("timestamp"))


def _from(df: DataFrame, day: str, col: str = "observed_at") -> DataFrame:
    return df.filter(F.col(col) >= F.lit(day).cast("timestamp"))


# sources, sinks, table maintenance


@query
def scan_trips_csv(f: Fleet) -> DataFrame:
    path = fresh_path(f.spark, "trips-csv")
    nothing = F.lit(None)
    f.trips.select(
        "ride_id",
        "rideable_type",
        "started_at",
        F.col("started_at").alias("ended_at"),
        nothing.cast("string").alias("start_station_name"),
        "start_station_id",
        nothing.cast("string").alias("end_station_name"),
        nothing.cast("string").alias("end_station_id"),
        *(
            nothing.cast("double").alias(c)
            for c in ("start_lat", "start_lng", "end_lat", "end_lng")
        ),
        F.lit("member").alias("member_casual"),
    ).write.option("header", True).option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS"
    ).csv(path)
    return files.scan_trips_csv(f.spark, path).select(
        "ride_id", "rideable_type", "started_at", "start_station_id", "start_lat", "member_casual"
    )


@query
def load_month_once(f: Fleet) -> DataFrame:
    path = fresh_path(f.spark, "trips-by-month")
    for _ in range(2):  # the second load finds every month in place
        tables.load_months(f.trips, path)
    return (
        tables.read_months(f.spark, path)
        .groupBy("source_month")
        .agg(F.count("*").alias("trips"), F.min("started_at").alias("first_start"))
    )


@query
def load_report(f: Fleet) -> DataFrame:
    """The first month is there already; the load of all months skips it."""
    path = fresh_path(f.spark, "trips-report")
    first = f.trips.agg(F.min("source_month")).scalar()
    tables.load_months(f.trips.filter(F.col("source_month") == first), path)
    return tables.load_report(f.trips, path)


@query
def scan_snapshot_json(f: Fleet) -> DataFrame:
    path = fresh_path(f.spark, "snapshots")
    files.snapshot_documents(f.status).write.json(path)
    return files.scan_snapshot_json(f.spark, path)


@query
def epoch_to_ts(f: Fleet) -> DataFrame:
    seconds = F.when(F.col("event_id") % 5 == 0, 0).when(
        F.col("event_id") % 7 != 0, F.unix_seconds("ts")
    )
    return f.events.select("event_id", timeutil.epoch_to_ts(seconds).alias("at"))


@query
def mirror_incremental(f: Fleet) -> DataFrame:
    path = fresh_path(f.spark, "mirror")
    tables.mirror_incremental(_before(f.status, MIDDLE), path, "observed_at")
    mirror = tables.mirror_incremental(f.status, path, "observed_at")
    return mirror.groupBy(F.to_date("observed_at").alias("day")).agg(
        F.count("*").alias("rows"), F.count_distinct("station_id").alias("stations")
    )


@query
def replace_dimension(f: Fleet) -> DataFrame:
    path = fresh_path(f.spark, "dimension")
    day = F.col("fetched_on")
    tables.replace_dimension(f.info.filter(day == "2024-01-01"), path)
    return tables.replace_dimension(f.info.filter(day == "2024-01-15"), path)


@query
def insert_ignore(f: Fleet) -> DataFrame:
    target = _before(f.status, MIDDLE).select(
        "station_id", "observed_at", F.col("num_bikes_available").alias("bikes"), F.lit(0).alias("copy")
    )
    twice = _from(f.status, "2024-01-10").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    incoming = twice.select(
        "station_id",
        "observed_at",
        (F.col("num_bikes_available") + 100 * F.col("copy")).alias("bikes"),
        "copy",
    )
    return tables.insert_ignore(target, incoming, ["station_id", "observed_at"], "copy")


@query
def upsert_latest(f: Fleet) -> DataFrame:
    current = cdc.cdc_latest(_before(f.status, MIDDLE), time_col="observed_at")
    return tables.upsert_latest(current, _from(f.status, MIDDLE), ["station_id"], "observed_at")


@query
def daily_snapshot_once(f: Fleet) -> DataFrame:
    today = deltas.latest_station_info(f.info)
    target = f.info
    for day in ("2024-01-15", "2024-01-20"):
        target = target.unionByName(tables.daily_snapshot_once(target, today, day))
    return target.select("station_id", "fetched_on", "name")


@query
def update_from(f: Fleet) -> DataFrame:
    judged = calibrate.relabel_events(f.deltas, f.thresholds)
    new = judged.select("station_id", "bucket", F.col("new_class").alias("event_class"))
    updated = tables.update_from(f.deltas, new, ["station_id", "bucket"], ["event_class"])
    return updated.groupBy("event_class").agg(
        F.count("*").alias("rows"), F.sum("d_bikes").alias("net_bikes")
    )


@query
def materialize(f: Fleet) -> DataFrame:
    daily = f.status.groupBy("station_id", F.to_date("observed_at").alias("day")).agg(
        F.count("*").alias("rows")
    )
    return tables.materialize(daily, fresh_path(f.spark, "daily"))


@query
def retention_plan(f: Fleet) -> DataFrame:
    return tables.retention_plan(f.status, "observed_at")


@query
def mirror_reconcile(f: Fleet) -> DataFrame:
    lost = (F.col("station_id") == "S1") & (F.col("observed_at") >= "2024-01-05")
    return tables.mirror_reconcile(f.status, f.status.filter(~lost), "observed_at")


@query
def retention_delete(f: Fleet) -> DataFrame:
    path = fresh_path(f.spark, "log-by-day")
    tables.write_days(f.status, path, "observed_at")
    lost = F.to_date("observed_at") == "2024-01-05"
    try:
        tables.retention_run(f.spark, path, f.status.filter(~lost), "observed_at")
    except tables.NotMirrored:  # a day the mirror lacks: nothing was deleted
        kept = tables.retention_run(f.spark, path, f.status, "observed_at")
    return kept.select("station_id", "observed_at", "num_bikes_available")


@query
def export_document(f: Fleet) -> DataFrame:
    frames = export.frame_rows(f.frame_cells, f.stations)
    document = export.export_document(f.stations, export.fleet_series(f.frame_cells), frames, f.vans)
    path = fresh_path(f.spark, "document")
    export.write_document(document, path)
    return export.read_document(f.spark, path)


# change data capture and streaming

KEPT = ["station_id", "polled_at", *STATE_FIELDS]


@query
def cdc_batch(f: Fleet) -> DataFrame:
    return cdc.cdc_batch(f.series).select(*KEPT)


@query
def cdc_incremental(f: Fleet) -> DataFrame:
    current = cdc.cdc_latest(_before(f.status, MIDDLE), time_col="observed_at")
    known = current.filter(F.col("station_id") != "S2")  # S2 is new to the state
    snapshot = cdc.cdc_latest(f.status, time_col="observed_at")
    return cdc.cdc_incremental(snapshot, known)


def _as_it_comes(f: Fleet, rows: DataFrame, key: str, time_col: str, label: str, capture) -> DataFrame:
    """Run a streaming job over ``rows`` as files in no order; a heartbeat at the end releases the last rows.

    The delay is that of a feed whose disorder is its whole length.
    """
    feed = fresh_path(f.spark, f"{label}-feed")
    rows.write.parquet(feed)
    groups = keyed.groups_for(f.spark.read.schema(rows.schema).parquet(feed).count(), shuffle_width(f.spark))
    keyed.heartbeat(rows, key, time_col, AFTER_ALL).write.mode("append").parquet(feed)
    stream = f.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", MICRO_BATCH_FILES)
    return jobs.run_available(capture(stream.parquet(feed), delay="40 days", groups=groups), label)


@query
def cdc_stream(f: Fleet) -> DataFrame:
    return _as_it_comes(f, f.series.select(*KEPT), "station_id", "polled_at", "cdc", keyed.cdc_stream)


@query
def poll_job(f: Fleet) -> DataFrame:
    """The poll log of the poller as one job, run twice: the second run goes on from the first one's state."""
    return _polled(f).polls()


@query
def poll_job_current(f: Fleet) -> DataFrame:
    """The current state that the poller's job keeps."""
    return _polled(f).current()


def _polled(f: Fleet) -> poll.PollTables:
    rows = f.series.select(*KEPT)
    feed = fresh_path(f.spark, "poll-feed")
    tables = poll.PollTables(f.spark, fresh_path(f.spark, "poll-tables"), rows.schema)
    for part in (_before(rows, MIDDLE, "polled_at"), _from(rows, MIDDLE, "polled_at")):
        part.write.mode("append").parquet(feed)
        poll.run_polls(f.spark.readStream.schema(rows.schema).parquet(feed), tables)
    return tables


@query
def cdc_threshold(f: Fleet) -> DataFrame:
    return cdc.cdc_threshold(f.vehicles)


@query
def cdc_threshold_stream(f: Fleet) -> DataFrame:
    return _as_it_comes(f, f.vehicles, "bike_id", "observed_at", "vehicles", keyed.vehicle_stream)


@query
def cdc_latest(f: Fleet) -> DataFrame:
    return cdc.cdc_latest(cdc.cdc_batch(f.series))


@query
def cdc_stats(f: Fleet) -> DataFrame:
    return cdc.cdc_stats(cdc.cdc_flags(f.series))


@query
def poll_summary(f: Fleet) -> DataFrame:
    return cdc.poll_summary(f.polls, cdc.cdc_flags(f.series))


@query
def tumbling_grid_stream(f: Fleet) -> DataFrame:
    path = fresh_path(f.spark, "observations")
    f.status.select("station_id", "observed_at").write.parquet(path)
    stream = f.spark.readStream.schema("station_id string, observed_at timestamp").parquet(path)
    counts = jobs.tumbling_counts(stream, "observed_at")
    return jobs.run_upserting(counts, "tumbling", ["bucket"], "observations")


@query
def insert_ignore_stream(f: Fleet) -> DataFrame:
    """Every row delivered twice; the first copy of a key stays."""
    path = fresh_path(f.spark, "twice")
    rows = f.status.select("station_id", "observed_at", "num_bikes_available")
    rows.unionAll(rows).write.parquet(path)
    stream = f.spark.readStream.schema(rows.schema).parquet(path)
    firsts = jobs.first_only(stream, ["station_id", "observed_at"], "observed_at")
    return jobs.run_available(firsts, "firsts")


@query
def upsert_latest_stream(f: Fleet) -> DataFrame:
    rows = f.status.select("station_id", "observed_at", "num_bikes_available")
    feed = fresh_path(f.spark, "upsert-feed")
    jobs.feed_in_order(rows, "observed_at", feed, MICRO_BATCH_ROWS)
    stream = f.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1)
    return jobs.run_upserting(stream.parquet(feed), "upsert", ["station_id"], "observed_at", "append")


# grid


@query
def time_bucket_5m(f: Fleet) -> DataFrame:
    return f.events.groupBy(timeutil.floor_bucket(F.col("ts")).alias("bucket")).agg(F.count("*").alias("rows"))


@query
def bucket_spine(f: Fleet) -> DataFrame:
    return grid.bucket_spine(f.polls)


@query
def bucket_coverage(f: Fleet) -> DataFrame:
    return grid.bucket_coverage(f.polls)


@query
def station_spine(f: Fleet) -> DataFrame:
    return grid.station_spine(f.status)


@query
def grid_spine(f: Fleet) -> DataFrame:
    return grid.grid_spine(f.status, f.covered)


@query
def grid_status(f: Fleet) -> DataFrame:
    return grid.grid_status(f.status, f.covered)


@query
def grid_flags(f: Fleet) -> DataFrame:
    return grid.grid_flags(f.grid).select(
        "bucket", "station_id", "classic_available", "is_stale", "is_serving"
    )


@query
def fill_age_histogram(f: Fleet) -> DataFrame:
    return grid.fill_age_histogram(f.grid)


@query
def grid_summary(f: Fleet) -> DataFrame:
    return grid.grid_summary(f.grid)


# deltas and vans


@query
def lag_multi(f: Fleet) -> DataFrame:
    return deltas.with_previous(f.grid)


@query
def station_deltas(f: Fleet) -> DataFrame:
    return deltas.station_deltas(f.grid).drop("event_class")


@query
def event_class(f: Fleet) -> DataFrame:
    label = deltas.event_class(F.lit(VAN_MIN_BIKES), F.lit(VAN_MIN_BIKES), VAN_MIN_BIKES)
    return f.deltas.select("bucket", "station_id", "d_bikes", label.alias("event_class"))


@query
def event_class_rollup(f: Fleet) -> DataFrame:
    return deltas.event_class_rollup(f.deltas)


@query
def van_totals(f: Fleet) -> DataFrame:
    return deltas.van_totals(f.deltas)


@query
def latest_station_info(f: Fleet) -> DataFrame:
    return deltas.latest_station_info(f.info)


@query
def van_listing(f: Fleet) -> DataFrame:
    return deltas.van_listing(f.deltas, f.info)


@query
def van_threshold_sweep(f: Fleet) -> DataFrame:
    return deltas.van_threshold_sweep(f.deltas)


@query
def van_gap_latency(f: Fleet) -> DataFrame:
    return deltas.van_gap_latency(f.deltas)


# surprise thresholds


@query
def flow_rates(f: Fleet) -> DataFrame:
    return calibrate.flow_rates(calibrate.move_histogram(f.grid, f.deltas))


@query
def poisson_threshold(f: Fleet) -> DataFrame:
    lam = F.pmod(F.col("event_id"), F.lit(1000)) / 16.0
    return f.events.select("event_id", lam.alias("lam")).withColumn(
        "k", surprise_threshold(F.col("lam"))
    )


@query
def cell_thresholds(f: Fleet) -> DataFrame:
    return calibrate.cell_thresholds(f.rates)


@query
def relabel_events(f: Fleet) -> DataFrame:
    return calibrate.relabel_events(f.deltas, f.thresholds).select(
        "station_id", "bucket", "event_class", "new_class"
    )


@query
def label_churn(f: Fleet) -> DataFrame:
    return calibrate.label_churn(calibrate.relabel_events(f.deltas, f.thresholds))


@query
def calibrate_vans(f: Fleet) -> DataFrame:
    done = calibrate.calibrate_vans(f.grid, f.deltas, histogram=f.moves)
    return done.rounds.withColumn("converged", F.lit(done.converged))


@query
def calibrated_deltas(f: Fleet) -> DataFrame:
    return f.calibrated.select("bucket", "station_id", "d_bikes", "event_class")


@query
def threshold_median(f: Fleet) -> DataFrame:
    return calibrate.threshold_median(f.thresholds)


@query
def threshold_by_activity(f: Fleet) -> DataFrame:
    return calibrate.threshold_by_activity(f.rates, f.thresholds)


# demand


@query
def local_daytype_hour(f: Fleet) -> DataFrame:
    at = F.col("ts")
    return f.events.select(
        "event_id",
        timeutil.local_hour(at, LOCAL_ZONE).alias("hour"),
        timeutil.local_daytype(at, LOCAL_ZONE).alias("daytype"),
    )


@query
def exposure(f: Fleet) -> DataFrame:
    return demand.exposure(f.grid)


@query
def rider_departures(f: Fleet) -> DataFrame:
    return demand.rider_departures(demand.exposure(f.grid), f.calibrated).select(
        "station_id", "bucket", "ebike_dep", "classic_dep"
    )


@query
def demand_cells(f: Fleet) -> DataFrame:
    return demand.demand_cells(demand.demand_observations(f.grid, f.calibrated))


@query
def station_prior(f: Fleet) -> DataFrame:
    return demand.station_prior(f.cells)


@query
def demand_baseline(f: Fleet) -> DataFrame:
    cells = demand.demand_cells(demand.demand_observations(f.grid, f.calibrated))
    return demand.demand_baseline(cells)


@query
def demand_summary(f: Fleet) -> DataFrame:
    return demand.demand_summary(f.demand)


@query
def demand_hourly_profile(f: Fleet) -> DataFrame:
    return demand.demand_hourly_profile(f.demand)


# outages and health


@query
def outage_flags(f: Fleet) -> DataFrame:
    return outages.outage_flags(f.grid, f.demand)


@query
def outage_islands(f: Fleet) -> DataFrame:
    flags = outages.outage_flags(f.grid, f.demand)
    return outages.outage_islands(flags).select(
        "bucket", "station_id", "starved", "saturated", "rn", "grp_starve", "grp_sat"
    )


@query
def outage_runs(f: Fleet) -> DataFrame:
    return outages.outage_runs(outages.outage_islands(outages.outage_flags(f.grid, f.demand)))


@query
def outage_events(f: Fleet) -> DataFrame:
    return outages.outage_events(f.runs)


@query
def outage_stats(f: Fleet) -> DataFrame:
    return outages.outage_stats(f.outages)


@query
def outage_stats_merged(f: Fleet) -> DataFrame:
    """Statistics merged from monthly sketches; are the quantiles within 2 % of their rank?"""
    path = fresh_path(f.spark, "outage-sketches")
    found = outages.merged_outage_stats(outages.store_outage_sketches(f.outages, path))
    asked = found.select("kind", "events", "max_minutes", "lost_trips", "median_minutes", "p90_minutes")

    def near(quantile: str, rank: float) -> Column:
        below, upto = (F.count_if(c) / F.count("*") for c in (F.col("minutes") < F.col(quantile), F.col("minutes") <= F.col(quantile)))
        return (below <= rank + 0.02) & (upto >= rank - 0.02)

    met = f.outages.select("kind", "minutes").join(F.broadcast(asked), "kind")  # a row per kind
    return met.groupBy("kind", "events", "max_minutes", "lost_trips").agg(
        near("median_minutes", 0.5).alias("median_near"), near("p90_minutes", 0.9).alias("p90_near")
    )


@query
def outage_concentration(f: Fleet) -> DataFrame:
    return outages.outage_concentration(f.outages, f.grid)


@query
def worst_stations(f: Fleet) -> DataFrame:
    return outages.worst_stations(f.outages, f.info)


@query
def outage_duration_sweep(f: Fleet) -> DataFrame:
    return outages.outage_duration_sweep(f.runs)


@query
def station_health(f: Fleet) -> DataFrame:
    return health.station_health(f.grid, f.demand)


@query
def health_shares(f: Fleet) -> DataFrame:
    return health.health_shares(f.health)


@query
def health_by_hour(f: Fleet) -> DataFrame:
    return health.health_by_hour(health.station_health(f.grid, f.demand, clock=True))


# forecast


@query
def forecast_features(f: Fleet) -> DataFrame:
    return forecast.forecast_features(f.grid, f.demand)


@query
def chrono_split(f: Fleet) -> DataFrame:
    rows = f.grid.select("bucket", "station_id")
    return (
        forecast.chrono_split(rows, f.grid)
        .groupBy("is_test")
        .agg(
            F.count("*").alias("rows"),
            F.min("bucket").alias("first_bucket"),
            F.max("bucket").alias("last_bucket"),
        )
    )


@query
def runway_score(f: Fleet) -> DataFrame:
    return forecast.runway_score(f.features).select("horizon", "bucket", "station_id", "b0")


@query
def average_precision(f: Fleet) -> DataFrame:
    scored = forecast.runway_score(f.features)
    return forecast.average_precision(scored, ["horizon", "is_test"], "b0", "starved_future")


@query
def forecast_skill(f: Fleet) -> DataFrame:
    return forecast.forecast_skill(forecast.runway_score(f.features))


@query
def onset_skill(f: Fleet) -> DataFrame:
    return forecast.onset_skill(forecast.runway_score(f.features))


@query
def boosted_model(f: Fleet) -> DataFrame:
    """All horizons. The trees' own scores depend on the engine (``model_report``); what they were scored on does not."""
    both = forecast.forecast_skill(f.boosted, "m1").withColumn("onset", F.lit(False)).unionByName(
        forecast.onset_skill(f.boosted, "m1").withColumn("onset", F.lit(True))
    )
    return both.select("horizon", "onset", "test_rows", "base_rate")


@query
def model_report(f: Fleet) -> DataFrame:
    """What the trees score beside chance and beside demand alone."""
    return forecast.model_report(f.boosted)


# dispatch


@query
def decision_epochs(f: Fleet) -> DataFrame:
    return dispatch.decision_epochs(dispatch.decision_rows(f.grid, f.demand))


@query
def deficits_donors(f: Fleet) -> DataFrame:
    rows = dispatch.decision_rows(f.grid, f.demand)
    return dispatch.deficits_donors(rows, dispatch.decision_epochs(rows))


@query
def rank_deficits_donors(f: Fleet) -> DataFrame:
    return dispatch.rank_deficits_donors(f.sized).select(
        "bucket", "station_id", "kind", "size", "rank"
    )


@query
def haversine_km(f: Fleet) -> DataFrame:
    spots = deltas.latest_station_info(f.info.select("station_id", "fetched_on", "lat", "lon"))
    return spots.select(
        "station_id", haversine(F.lit(37.7749), F.lit(-122.4194), F.col("lat"), F.col("lon")).alias("km")
    )


@query
def nearest_donor(f: Fleet) -> DataFrame:
    return dispatch.nearest_donor(f.located)


# export frames


@query
def service_zone(f: Fleet) -> DataFrame:
    zone = export.service_zone(F.col("region_id"), F.col("lat"), F.col("lon"))
    return f.info.select("station_id", "fetched_on", zone.alias("zone"))


@query
def export_window(f: Fleet) -> DataFrame:
    return export.export_window(export.window_buckets(f.grid))


def _codes(f: Fleet, code: str) -> DataFrame:
    cells = export.frame_cells(f.grid, f.demand, f.window, f.stations)
    return cells.select("frame", "station_id", code)


@query
def state_code(f: Fleet) -> DataFrame:
    return _codes(f, "state")


@query
def demand_code(f: Fleet) -> DataFrame:
    return _codes(f, "demand_state")


@query
def runway_code(f: Fleet) -> DataFrame:
    return _codes(f, "runway_state")


@query
def fleet_series(f: Fleet) -> DataFrame:
    return export.fleet_series(f.frame_cells)


@query
def frame_strings(f: Fleet) -> DataFrame:
    return export.frame_rows(f.frame_cells, f.stations).drop("ebikes")


@query
def ebike_matrix(f: Fleet) -> DataFrame:
    counts = export.frame_rows(f.frame_cells, f.stations)
    return counts.select("frame", F.array_join(F.col("ebikes").cast("array<string>"), ",").alias("ebikes"))


@query
def van_nearest_frame(f: Fleet) -> DataFrame:
    return f.vans


@query
def station_list(f: Fleet) -> DataFrame:
    return export.station_list(f.info)


@query
def bucketed_events(f: Fleet) -> DataFrame:
    return export.bucketed_events(f.vans, f.window)


# validation, audit, freshness


@query
def demand_vs_trips(f: Fleet) -> DataFrame:
    return validate.demand_vs_trips(f.info, f.demand, f.trips)


@query
def pearson(f: Fleet) -> DataFrame:
    return validate.pearson(f.compared)


@query
def rank_corr(f: Fleet) -> DataFrame:
    return validate.rank_corr(f.compared)


@query
def top_rank_disagreement(f: Fleet) -> DataFrame:
    return validate.top_rank_disagreement(f.compared)


@query
def hourly_shape(f: Fleet) -> DataFrame:
    return validate.hourly_shape(f.demand, f.trips)


@query
def shape_corr(f: Fleet) -> DataFrame:
    return validate.shape_corr(validate.hourly_shape(f.demand, f.trips))


@query
def bucket_coverage_pct(f: Fleet) -> DataFrame:
    return audit.bucket_coverage_pct(f.polls)


@query
def longest_gap(f: Fleet) -> DataFrame:
    return audit.longest_gap(f.polls)


@query
def poll_errors(f: Fleet) -> DataFrame:
    return audit.poll_errors(f.polls)


@query
def coverage_gate(f: Fleet) -> DataFrame:
    return audit.coverage_gate(audit.bucket_coverage_pct(f.polls))


@query
def collection_summary(f: Fleet) -> DataFrame:
    return audit.collection_summary(f.polls, f.status)


@query
def since_filter(f: Fleet) -> DataFrame:
    return audit.since_filter(f.polls, start=MIDDLE)


@query
def freshness_check(f: Fleet) -> DataFrame:
    return freshness.freshness_check(
        [
            ("station_status", f.status, "observed_at"),
            ("grid_status", f.grid, "bucket"),
            ("station_deltas", f.deltas, "bucket"),
            ("outage_events", f.outages, "ended_at"),
        ]
    )


@query
def source_lag(f: Fleet) -> DataFrame:
    """Against a mirror that was last brought up to date on 2024-01-28."""
    path = fresh_path(f.spark, "lagging-mirror")
    mirror = tables.mirror_incremental(_before(f.status, "2024-01-28"), path, "observed_at")
    return freshness.source_lag(f.status, mirror, "observed_at")
