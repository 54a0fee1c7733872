"""Running a maintenance step again changes nothing."""

import time
from datetime import timedelta

import pytest
from helpers import at, minute_of
from pyspark.sql import functions as F

from pedalgrid.constants import STATE_FIELDS
from pedalgrid.session import fresh_path
from pedalgrid.sources import files, tables

LOG = "k string, t timestamp, v int"


def log(spark, rows):
    return spark.createDataFrame([(k, at(m), v) for k, m, v in rows], LOG)


def plain(df):
    return sorted((r.k, minute_of(r.t), r.v) for r in df.collect())


def test_mirror_appends_only_newer_rows(spark):
    path = fresh_path(spark, "t-mirror")
    rows = [("a", 0, 1), ("b", 5, 2), ("a", 9, 3)]
    tables.mirror_incremental(log(spark, rows[:2]), path, "t")
    for _ in range(2):
        mirror = tables.mirror_incremental(log(spark, rows), path, "t")
    assert plain(mirror) == sorted(("a" if k == "a" else "b", float(m), v) for k, m, v in rows)
    late = log(spark, [*rows, ("c", 8, 4)])
    assert tables.mirror_incremental(late, path, "t").count() == 3  # older than the mark: lost
    for _ in range(2):
        mirror = tables.mirror_incremental(late, path, "t", keys=["k", "t"], overlap_minutes=5)
    assert mirror.count() == 4


def test_month_is_loaded_once(spark):
    path = fresh_path(spark, "t-months")
    rows = log(spark, [("a", 0, 1)]).withColumn("source_month", F.lit("202403"))
    assert [tables.load_month_once(rows, path, m) for m in ("202403", "202403", "202404")] == [1, 0, 1]
    got = tables.read_months(spark, path)
    assert sorted(r.source_month for r in got.collect()) == ["202403", "202404"]


def test_insert_ignore_and_upsert_are_idempotent(spark):
    target = log(spark, [("a", 0, 1), ("b", 0, 2)])
    incoming = log(spark, [("a", 0, 9), ("c", 0, 5), ("c", 0, 6)])
    once = tables.insert_ignore(target, incoming, ["k", "t"], "v")
    assert plain(once) == [("a", 0.0, 1), ("b", 0.0, 2), ("c", 0.0, 5)]
    assert plain(tables.insert_ignore(once, incoming, ["k", "t"], "v")) == plain(once)
    newer = log(spark, [("a", 7, 3), ("b", -1, 9)])
    state = tables.upsert_latest(target, newer, ["k"], "t")
    assert plain(state) == [("a", 7.0, 3), ("b", 0.0, 2)]
    assert plain(tables.upsert_latest(state, newer, ["k"], "t")) == plain(state)


def test_upsert_takes_the_correction(spark):
    target, fixed = log(spark, [("a", 5, 1)]), log(spark, [("a", 5, 0)])
    assert plain(tables.upsert_latest(target, fixed, ["k"], "t")) == [("a", 5.0, 0)]


def test_months_are_loaded_in_one_write(spark):
    path = fresh_path(spark, "t-many-months")
    rows = log(spark, [("a", 0, 1), ("b", 1, 2)]).withColumn("source_month", F.concat(F.lit("20240"), F.col("v")))
    assert [tables.load_months(rows, path) for _ in range(2)] == [2, 0]
    more = rows.unionByName(log(spark, [("c", 2, 3)]).withColumn("source_month", F.lit("202403")))
    assert tables.load_months(more, path) == 1
    assert tables.read_months(spark, path).count() == 3


def test_mark_does_not_pass_a_repeated_hour(spark, monkeypatch):
    """09:00 to 09:30 UTC is the hour that the driver's clock shows twice."""
    monkeypatch.setenv("TZ", "America/Los_Angeles")
    time.tzset()
    try:
        at_utc = F.timestamp_micros(F.lit(1730624400_000_000) + F.col("id") * 600_000_000)
        rows = spark.range(4).select(F.col("id").cast("string").alias("k"), at_utc.alias("t"))
        path = fresh_path(spark, "t-dst")
        assert [tables.mirror_incremental(rows, path, "t").count() for _ in range(3)] == [4, 4, 4]
    finally:
        monkeypatch.undo()
        time.tzset()


def test_load_report_tells_loaded_from_skipped(spark):
    path = fresh_path(spark, "t-report")
    rows = spark.createDataFrame([("a", "202403"), ("b", "202403"), ("c", "202404")], "ride_id string, source_month string")
    report = lambda part: sorted(tuple(r) for r in tables.load_report(part, path).collect())
    assert report(rows.filter("ride_id <> 'c'")) == [("202403", 2, True)]
    more = rows.unionByName(rows.filter("ride_id = 'a'"))  # a month that is there is not touched
    assert report(more) == [("202403", 2, False), ("202404", 1, True)]


def test_retention_run_changes_the_table(spark):
    path = fresh_path(spark, "t-days")
    source = log(spark, [("a", d * 1440 + h * 360, 4 * d + h) for d in range(20) for h in range(4)])
    tables.write_days(source, path, "t")
    with pytest.raises(tables.NotMirrored):
        tables.retention_run(spark, path, source.filter("v <> 9"), "t", 14)
    assert tables.read_days(spark, path).count() == 80
    kept = tables.retention_run(spark, path, source, "t", 14)
    newest = source.agg(F.max("t")).first()[0]
    want = [r.v for r in source.collect() if r.t >= newest - timedelta(days=14)]
    assert sorted(r.v for r in kept.collect()) == sorted(want)
    assert tables.retention_run(spark, path, source, "t", 14).count() == len(want)


def test_daily_snapshot(spark):
    dim = spark.createDataFrame([("a", "x")], "k string, name string").withColumn("fetched_on", F.lit("2024-01-01").cast("date"))
    now = spark.createDataFrame([("a", "y"), ("b", "z")], "k string, name string")
    assert tables.daily_snapshot_once(dim, now, "2024-01-01").count() == 0
    assert tables.daily_snapshot_once(dim, now, "2024-01-02").count() == 2


def test_update_from_can_set_null_and_keeps_the_rest(spark):
    target = log(spark, [("a", 0, 1), ("b", 0, 2), ("c", 0, 3)])
    updates = spark.createDataFrame([("a", 9), ("b", None)], "k string, v int")
    assert [r.v for r in tables.update_from(target, updates, ["k"], ["v"]).orderBy("k").collect()] == [9, None, 3]


def test_retention_needs_a_full_mirror(spark):
    day = 1440
    source = log(spark, [("a", d * day, d) for d in range(20)])
    plan = tables.retention_plan(source, "t", keep_days=14).first()
    assert (plan.total, plan.doomed) == (20, 5)
    short = source.filter("v <> 2")
    checked = tables.mirror_reconcile(source, short, "t", 14).orderBy("day").collect()
    assert [r.ok for r in checked] == [True, True, False, True, True]
    assert tables.retention_delete(source, short, "t", 14).count() == 20
    with pytest.raises(ValueError):
        tables.retention_delete(source, short, "t", 14, apply=True)
    more = source.unionByName(source.filter("v = 3"))
    assert tables.retention_delete(source, more, "t", 14, apply=True).count() == 15


def test_csv_keeps_ids_as_text_and_bad_rows_as_null(spark, tmp_path):
    head = (
        "ride_id,rideable_type,started_at,ended_at,start_station_name,start_station_id,"
        "end_station_name,end_station_id,start_lat,start_lng,end_lat,end_lng,member_casual\n"
    )
    (tmp_path / "t.csv").write_text(
        head + "007,electric_bike,2024-05-01 08:09:10.123,2024-05-01 09:00:00,X,012,Y,013,1.5,2.5,3.5,4.5,member\n"
    )
    r = files.scan_trips_csv(spark, str(tmp_path / "t.csv")).first()
    assert (r.ride_id, r.start_station_id, r.started_at.microsecond, r.start_lat) == ("007", "012", 123000, 1.5)


def test_snapshot_documents_are_bounded(spark, tmp_path):
    """A thousand rows of one hour make several documents, and all of them are read again."""
    fields = {c: F.lit(1).cast("int") for c in STATE_FIELDS}
    at = F.timestamp_seconds(F.lit(1700000000) + F.col("id") % 60)
    status = spark.range(0, 1000, 1, 3).select(
        F.format_string("s%d", "id").alias("station_id"), at.alias("observed_at"), at.alias("last_reported")
    ).withColumns(fields)
    docs = files.snapshot_documents(status, most=64)
    assert max(r[0] for r in docs.select(F.size("data.stations")).collect()) <= 64
    docs.write.json(str(tmp_path / "docs"))
    got = files.scan_snapshot_json(spark, str(tmp_path / "docs")).collect()
    assert sorted(r.station_id for r in got) == sorted(f"s{i}" for i in range(1000))
    assert len({r.feed_last_updated for r in got}) == 1


def test_snapshot_document_has_a_row_per_station(spark, tmp_path):
    (tmp_path / "s.json").write_text(
        '{"last_updated": 1700000000, "data": {"stations": ['
        '{"station_id": "a", "last_reported": 0, "num_bikes_available": 3}, '
        '{"station_id": "b", "last_reported": 1700000000, "is_renting": 1}]}}\n'
    )
    got = files.scan_snapshot_json(spark, str(tmp_path)).orderBy("station_id").collect()
    assert [(r.station_id, r.last_reported is None, r.num_bikes_available, r.is_renting) for r in got] == [
        ("a", True, 3, None), ("b", False, None, 1)]
