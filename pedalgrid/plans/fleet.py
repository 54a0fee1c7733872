"""The stages of the analysis over one input folder, each stored once per session.

Stages are lazy: asking for one builds what it needs and nothing else. Stored stages are
plain tables in the shared folder, so Spark knows their size (it decides on broadcasts by
itself) and a lost executor costs no recomputation of earlier stages.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedalgrid.operators import (
    calibrate,
    cdc,
    deltas,
    demand,
    dispatch,
    export,
    forecast,
    grid,
    health,
    outages,
    validate,
)
from pedalgrid.session import clean_up, configure, cut_lineage, fresh_path, store_bucketed
from pedalgrid.sources import events as ev


class Fleet:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.events = ev.read_events(spark, sf_dir)

    # inputs

    @cached_property
    def status(self) -> DataFrame:
        return cut_lineage(ev.station_status(self.events), "status")

    @property
    def polls(self) -> DataFrame:
        return ev.poll_log(self.events)

    @cached_property
    def info(self) -> DataFrame:
        return cut_lineage(ev.station_info(self.events), "info")

    @property
    def trips(self) -> DataFrame:
        return ev.trips(self.events)

    @property
    def series(self) -> DataFrame:
        return ev.raw_series(self.status)

    @property
    def vehicles(self) -> DataFrame:
        return cdc.vehicle_rows(ev.vehicle_series(self.events))

    # grid and deltas: one row per bucket and station, so bucketing by station is balanced

    @cached_property
    def covered(self) -> DataFrame:
        return cut_lineage(grid.bucket_coverage(self.polls), "covered")

    @cached_property
    def width(self) -> int:
        """Buckets of the grid and of what is stored beside it, row by row."""
        return grid.grid_width(self.status, self.covered)

    @cached_property
    def grid(self) -> DataFrame:
        rows = grid.grid_status(self.status, self.covered, width=self.width)
        return store_bucketed(rows, "grid", "station_id", "bucket", month_of="bucket", buckets=self.width)

    @cached_property
    def deltas(self) -> DataFrame:
        return store_bucketed(
            deltas.station_deltas(self.grid), "deltas", "station_id", "bucket", buckets=self.width
        )

    # labels and demand

    @cached_property
    def moves(self) -> DataFrame:
        return cut_lineage(calibrate.move_histogram(self.grid, self.deltas), "histogram")

    @cached_property
    def rates(self) -> DataFrame:
        return cut_lineage(calibrate.flow_rates(self.moves), "rates")

    @cached_property
    def thresholds(self) -> DataFrame:
        return cut_lineage(calibrate.cell_thresholds(self.rates), "thresholds")

    @cached_property
    def calibration(self) -> calibrate.Calibration:
        return calibrate.calibrate_vans(self.grid, self.deltas, histogram=self.moves)

    @cached_property
    def calibrated(self) -> DataFrame:
        """The deltas under their final labels: what demand and everything after it reads."""
        return store_bucketed(
            self.calibration.deltas, "calibrated", "station_id", "bucket", buckets=self.width
        )

    @cached_property
    def cells(self) -> DataFrame:
        return cut_lineage(
            demand.demand_cells(demand.demand_observations(self.grid, self.calibrated)), "cells"
        )

    @cached_property
    def demand(self) -> DataFrame:
        return cut_lineage(demand.demand_baseline(self.cells), "demand")

    # what the demand is used for

    @cached_property
    def runs(self) -> DataFrame:
        islands = outages.outage_islands(outages.outage_flags(self.grid, self.demand))
        return cut_lineage(outages.outage_runs(islands), "runs")

    @property
    def outages(self) -> DataFrame:
        return outages.outage_events(self.runs)

    @property
    def health(self) -> DataFrame:
        return health.station_health(self.grid, self.demand)

    @cached_property
    def outlook(self) -> DataFrame:
        rows = forecast.forecast_rows(self.grid, self.demand)
        return cut_lineage(forecast.chrono_split(rows, self.grid), "outlook")

    @property
    def features(self) -> DataFrame:
        """Fanned out on reading: five horizons share one stored row."""
        return forecast.by_horizon(self.outlook)

    @cached_property
    def models(self) -> tuple[str, list[int]]:
        """Where the fitted trees lie, and for which horizons."""
        folder = fresh_path(self.spark, "models")
        return folder, forecast.fit_models(self.features, folder)

    @cached_property
    def boosted(self) -> DataFrame:
        return cut_lineage(forecast.score_models(self.features, *self.models), "boosted")

    @cached_property
    def sized(self) -> DataFrame:
        rows = dispatch.decision_rows(self.grid, self.demand)
        epochs = dispatch.decision_epochs(rows)
        return cut_lineage(dispatch.deficits_donors(rows, epochs), "sized")

    @cached_property
    def located(self) -> DataFrame:
        return cut_lineage(dispatch.placed(self.sized, self.info), "located")

    @cached_property
    def nearest(self) -> DataFrame:
        return cut_lineage(dispatch.nearest_donor(self.located), "nearest")

    @cached_property
    def stations(self) -> DataFrame:
        return cut_lineage(export.station_list(self.info), "stations")

    @cached_property
    def window(self) -> DataFrame:
        return cut_lineage(export.window_buckets(self.grid), "window")

    @cached_property
    def frame_cells(self) -> DataFrame:
        return cut_lineage(
            export.frame_cells(self.grid, self.demand, self.window, self.stations), "frame-cells"
        )

    @property
    def vans(self) -> DataFrame:
        return export.van_nearest_frame(self.calibrated, self.window, self.stations)

    @cached_property
    def compared(self) -> DataFrame:
        return cut_lineage(
            validate.demand_vs_trips(self.info, self.demand, self.trips), "compared"
        )


_fleets: dict[tuple[str, str], Fleet] = {}


def fleet(spark: SparkSession, sf_dir: str) -> Fleet:
    """The stages for one folder in this session; a new session builds its own."""
    key = (configure(spark).sparkContext.applicationId, str(sf_dir))
    if key not in _fleets:
        _fleets[key] = Fleet(spark, str(sf_dir))
    return _fleets[key]


def forget(spark: SparkSession, sf_dir: str) -> None:
    """Let the next call build every stage anew."""
    _fleets.pop((spark.sparkContext.applicationId, str(sf_dir)), None)


def close(spark: SparkSession) -> int:
    """Forget all stages of this session and remove their tables and folders."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _fleets if k[0] == app]:
        del _fleets[key]
    return clean_up(spark)


def plain(df: DataFrame) -> DataFrame:
    """Instants as UTC clock time, which any reader takes for the same value."""
    instants = {
        f.name: F.col(f"`{f.name}`").cast("timestamp_ntz")
        for f in df.schema.fields
        if f.dataType.typeName() == "timestamp"
    }
    return df.withColumns(instants) if instants else df


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, where summation order may differ."""
    doubles = {
        f.name: F.round(f"`{f.name}`", digits)
        for f in df.schema.fields
        if f.dataType.typeName() == "double"
    }
    return df.withColumns(doubles) if doubles else df
