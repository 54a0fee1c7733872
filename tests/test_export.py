import json

import pytest
from helpers import demand_frame, grid_frame, minute_of
from pyspark.sql import functions as F

from pedalgrid.operators import export
from pedalgrid.session import fresh_path

INFO = (
    "station_id string, fetched_on date, name string, short_name string, lat double, lon double, "
    "region_id string, capacity int"
)


def info(spark, stations):
    rows = [(s, d, f"{s} {d}", s, 37.75, -122.41, "3", 15) for s in stations for d in ("2024-01-01", "2024-02-01")]
    df = spark.createDataFrame([(*r[:1], None, *r[2:]) for r in rows], INFO)
    days = spark.createDataFrame([(r[0], r[2], r[1]) for r in rows], "station_id string, name string, d string")
    return df.drop("fetched_on").join(days, ["station_id", "name"]).withColumn("fetched_on", F.col("d").cast("date")).drop("d")


def test_zones(spark):
    df = spark.createDataFrame(
        [("12", 37.7, -122.4, 1), ("3", 37.8, -122.3, 1), ("5", 37.8, -122.4, 2), (None, 37.4, -122.4, 2),
         ("3", 37.75, -122.45, 0), (None, 37.8, -122.3, 1)],
        "r string, la double, lo double, want int",
    )
    got = df.select(export.service_zone(F.col("r"), F.col("la"), F.col("lo")).alias("z"), "want").collect()
    assert [r.z for r in got] == [r.want for r in got]


@pytest.mark.parametrize("chunk", [2, 1024])
def test_frames_mark_absent_stations(spark, chunk):
    names = ["A", "B", "C", "D", "E"]
    grid = grid_frame(
        spark,
        [("A", 0, 5, 40, 5, True), ("B", 0, 0, 0, 5, True), ("E", 0, 3, 2, 0, True), ("Z", 0, 2, 1, 1, True),
         ("A", 1, 5, 1, 5, True),  # dropped by the stride
         ("A", 2, 5, 0, 5, True), ("C", 2, 5, 1, 5, None), ("D", 2, None, None, None, None)],
    )
    stations = export.station_list(info(spark, names))
    assert [r.n for r in stations.orderBy("idx").collect()] == [f"{s} 2024-02-01" for s in names]
    buckets = export.window_buckets(grid)
    cells = export.frame_cells(grid, demand_frame(spark, names, 2.5), buckets, stations)
    got = {r.frame: r for r in export.frame_rows(cells, stations, chunk).collect()}
    assert (got[0].state, got[1].state) == ("02993", "19499")
    assert (got[0].demand_state, got[1].demand_state) == ("01995", "19499")
    assert (got[0].runway_state, got[1].runway_state) == ("03992", "39499")
    assert got[0].ebikes == [35, 0, 0, 0, 2] and got[1].ebikes == [0, 0, 1, 0, 0]
    series = {r.frame: r for r in export.fleet_series(cells).collect()}
    first = series[0]
    assert (first.bikes, first.ebikes, first.starved, first.empty, first.full) == (10, 43, 1, 1, 1)
    assert (first.short, first.doomed, first.watch) == (1, 1, 0)


def test_van_goes_to_the_nearest_frame_and_half_way_to_the_later(spark):
    grid = grid_frame(spark, [("A", i, 5, 1, 5, True) for i in (0, 1, 2, 3, 9, 10, 11)])
    # frames at buckets 0, 2, 9, 11
    buckets = export.window_buckets(grid)
    stations = export.station_list(info(spark, ["A"]))
    deltas = grid.select("bucket", "station_id", F.lit(6).alias("d_bikes"), F.lit("inferred_truck_dropoff").alias("event_class"))
    vans = export.van_nearest_frame(deltas, buckets, stations)
    got = {int(minute_of(r.bucket) / 5): r.frame for r in vans.collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 9: 2, 10: 3, 11: 3}
    shown = export.bucketed_events(vans, buckets, pulse=1).groupBy("frame").count().collect()
    assert {r.frame: r["count"] for r in shown} == {0: 1, 1: 4, 2: 4, 3: 3}


def test_window_is_the_last_week(spark):
    grid = grid_frame(spark, [("A", i, 5, 1, 5, True) for i in (0, 100, 101, 2116, 2117)])
    got = [r.position for r in export.window_buckets(grid).collect()]
    assert got == [0, 1, 2]  # bucket 101 is exactly seven days before 2117


def test_document_lines_parse(spark):
    grid = grid_frame(spark, [("A", i, 5, 1, 5, True) for i in range(3)])
    stations = export.station_list(info(spark, ["A", "B"]))
    buckets = export.window_buckets(grid)
    cells = export.frame_cells(grid, demand_frame(spark, ["A"]), buckets, stations)
    deltas = grid.select("bucket", "station_id", F.lit(-6).alias("d_bikes"), F.lit("inferred_truck_pickup").alias("event_class"))
    doc = export.export_document(
        stations, export.fleet_series(cells), export.frame_rows(cells, stations),
        export.van_nearest_frame(deltas, buckets, stations),
    )
    lines = [(r.part, r.seq, json.loads(r.doc)) for r in doc.orderBy("part", "seq").collect()]
    assert [p for p, _, _ in lines] == ["frame"] * 2 + ["station"] * 2 + ["van"] * 3 + ["zone"] * 3
    assert lines[0][2]["frame"] == "09" and lines[0][2]["series"]["t"] == "2024-03-04T12:00:00+00:00"
    assert lines[2][2] == {"n": "A 2024-02-01", "la": 37.75, "lo": -122.41, "c": 15, "z": 0}
    assert lines[4][2] == [0, 0, -6]


def test_frame_of_unplaced_stations_stays(spark):
    grid = grid_frame(spark, [("A", 0, 5, 1, 5, True), ("X", 2, 5, 1, 5, True)])
    stations = export.station_list(info(spark, ["A", "B"]))
    buckets = export.window_buckets(grid, stride=1)
    cells = export.frame_cells(grid, demand_frame(spark, ["A"]), buckets, stations)
    rows = {r.frame: (r.state, r.ebikes) for r in export.frame_rows(cells, stations).collect()}
    assert rows[1] == ("99", [0, 0]) and rows[0][0][1] == "9"
    doc = export.export_document(
        stations, export.fleet_series(cells), export.frame_rows(cells, stations),
        export.van_nearest_frame(grid.select("bucket", "station_id", F.lit(0).alias("d_bikes"), F.lit("idle").alias("event_class")), buckets, stations),
    )
    assert doc.filter("part = 'frame'").count() == 2
    path = fresh_path(spark, "t-document")
    export.write_document(doc, path)
    back = export.read_document(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, doc.collect()))
