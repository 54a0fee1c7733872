"""Change capture in batch and as a stream, against plain loops."""

import json
import random
from datetime import datetime, timezone
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from helpers import at, minute_of
from pyspark.sql import functions as F

from pedalgrid.constants import MOVE_METERS, RANGE_METERS, STATE_FIELDS
from pedalgrid.functions import drift
from pedalgrid.functions.ordered import time_slices
from pedalgrid.functions.vehicles import differs
from pedalgrid.operators import cdc
from pedalgrid.session import fresh_path
from pedalgrid.sources import files
from pedalgrid.streaming import jobs, keyed

SERIES = "station_id string, polled_at timestamp, " + ", ".join(f"{c} smallint" for c in STATE_FIELDS)
VEHICLES = (
    "bike_id string, observed_at timestamp, lat double, lon double, range_m int, "
    "is_disabled int, is_reserved int"
)


def series(spark, rows):
    return spark.createDataFrame(
        [(s, at(m), bikes, 0, 0, 5, 0, 1, 1, 1) for s, m, bikes in rows], SERIES
    )


def kept(df):
    return sorted((r.station_id, minute_of(r.polled_at)) for r in df.collect())


ROWS = [("A", 0, 1), ("A", 2, 1), ("A", 4, None), ("A", 6, None), ("A", 8, 1), ("B", 0, None), ("B", 2, None)]
WANT = [("A", 0.0), ("A", 4.0), ("A", 8.0), ("B", 0.0)]


def test_unknown_equals_unknown(spark):
    df = series(spark, ROWS)
    assert kept(cdc.cdc_batch(df)) == WANT
    assert cdc.cdc_stats(cdc.cdc_flags(df)).first()[:3] == (7, 4, 3)
    latest = {r.station_id: minute_of(r.polled_at) for r in cdc.cdc_latest(cdc.cdc_batch(df)).collect()}
    assert latest == {"A": 8.0, "B": 0.0}


def test_incremental_against_state(spark):
    current = series(spark, [("A", 0, 1), ("B", 0, None), ("gone", 0, 4)])
    snapshot = series(spark, [("A", 2, 1), ("B", 2, 3), ("new", 2, None)])
    assert kept(cdc.cdc_incremental(snapshot, current)) == [("B", 2.0), ("new", 2.0)]


def test_poll_summary_counts_nothing_for_failed_polls(spark):
    polls = spark.createDataFrame([(at(0), "ok", None), (at(2), "error", "E1"), (at(99), "ok", None)],
                                  "polled_at timestamp, status string, error string")
    got = cdc.poll_summary(polls, cdc.cdc_flags(series(spark, ROWS))).orderBy("polled_at").collect()
    assert [(r.stations_seen, r.rows_written, r.unchanged) for r in got] == [(2, 2, 0), (0, 0, 0), (0, 0, 0)]


def feed(spark, schema, capture, parts, label):
    """Run the job once per part, from where it stopped."""
    src, out, log = (fresh_path(spark, f"{label}-{x}") for x in ("feed", "out", "log"))
    for part in parts:
        part.write.mode("append").parquet(src)
        got = jobs.run_available(capture(spark.readStream.schema(schema).parquet(src)), label, out, log)
    return got


FAR = datetime(2100, 1, 1, tzinfo=timezone.utc)


def test_stream_resumes_and_ignores_redelivery(spark):
    first = series(spark, ROWS[:3] + ROWS[5:6])
    second = series(spark, ROWS[2:5] + ROWS[5:])  # overlaps the first part
    end = keyed.heartbeat(first, "station_id", "polled_at", FAR)
    assert kept(feed(spark, SERIES, keyed.cdc_stream, [first, second, end], "t-cdc")) == WANT


def test_stream_takes_rows_in_any_order_within_the_delay(spark):
    """Parts hold rows up to an hour apart in any order, some twice; each part is a run of its own from the checkpoint.
    Nothing is released before the watermark has passed it, and rows beyond the delay change nothing."""
    rnd = random.Random(4)
    rows = [(s, m, rnd.choice([1, 1, 2, None])) for s in "AB" for m in range(0, 300, 2)]
    want = kept(cdc.cdc_batch(series(spark, rows)))
    late = sorted(rows, key=lambda r: r[1] + rnd.uniform(0, 50))
    parts = [series(spark, late[i : i + 75] + late[max(0, i - 10) : i]) for i in range(0, 300, 75)]
    before = kept(feed(spark, SERIES, keyed.cdc_stream, parts, "t-order"))
    assert 0 < len(before) < len(want) and set(before) < set(want)
    end = keyed.heartbeat(parts[0], "station_id", "polled_at", FAR)
    beyond = series(spark, [("A", -500, 9)])
    assert kept(feed(spark, SERIES, keyed.cdc_stream, [*parts, beyond, end], "t-all")) == want


def loop(rows):
    """Keep against the last kept row, one row after the other."""
    out, anchor = [], {}
    for r in sorted(rows, key=lambda r: r[1]):
        row = SimpleNamespace(lat=r[2], lon=r[3], range_m=r[4], is_disabled=r[5], is_reserved=r[6])
        if differs(anchor.get(r[0]), row):
            anchor[r[0]] = row
            out.append((r[0], minute_of(r[1])))
    return sorted(out)


def wander(seed, n, hot_share):
    """Vehicles that mostly stand still or drift a little and rarely jump."""
    rnd = random.Random(seed)
    pos: dict[str, list] = {}
    rows = []
    for i in range(n):
        bike = "hot" if rnd.random() < hot_share else f"b{rnd.randrange(5)}"
        p = pos.setdefault(bike, [37.7, -122.4, 9000, 0, 0])
        act = rnd.random()
        if act < 0.5:
            p[0] += rnd.uniform(-1, 1) * 1e-4
            p[2] -= rnd.randrange(60)
        elif act < 0.53:
            p[1] += 0.01
        elif act < 0.55:
            p[3] = 1 - p[3]
        rows.append((bike, at(i), *p))
    return rows


@pytest.mark.parametrize("seed,share", [(1, 0.0), (2, 0.9)])
def test_threshold_batch_and_stream_equal_the_loop(spark, seed, share):
    rows = wander(seed, 1500, share)
    df = spark.createDataFrame(rows, VEHICLES)
    want = loop(rows)
    pick = lambda d: sorted((r.bike_id, minute_of(r.observed_at)) for r in d.collect())
    assert pick(cdc.cdc_threshold(df)) == want
    cut = F.col("observed_at") < F.lit(at(700))
    parts = [df.filter(cut), df.filter(~cut).unionByName(df.filter(cut).limit(100))]  # some come twice
    parts.append(keyed.heartbeat(df, "bike_id", "observed_at", FAR))
    assert pick(feed(spark, VEHICLES, keyed.vehicle_stream, parts, "t-veh")) == want


def run_in_groups(spark, parts, capture, label):
    """The rows kept over one run per part, and the rows of state: of its last rows per key, one per group."""
    src, out, log = (fresh_path(spark, f"{label}-{x}") for x in ("feed", "out", "log"))
    for part in parts:
        part.write.mode("append").parquet(src)
        got = jobs.run_available(capture(spark.readStream.schema(part.schema).parquet(src)), label, out, log)
    state = spark.read.format("statestore").option("stateVarName", "last").load(log)
    return got, state.count()


def test_changes_of_many_keys_in_few_groups(spark):
    """Keys of a group are kept apart, a key without an id too; the state has a row per group, not per key."""
    rnd = random.Random(7)
    keys = [None, *(f"S{k}" for k in range(30))]
    rows = [(s, m, rnd.choice([1, 1, 2, None])) for s in keys for m in range(0, 240, 6) if s != "S3" or not 60 < m < 180]
    shown = lambda df: sorted((str(r.station_id), minute_of(r.polled_at)) for r in df.collect())
    want = shown(cdc.cdc_batch(series(spark, [(s or "None", *r) for s, *r in rows])))
    late = sorted(rows, key=lambda r: r[1] + rnd.uniform(0, 50))
    parts = [series(spark, late[i : i + 500] + late[max(0, i - 40) : i]) for i in range(0, len(late), 500)]
    parts.append(keyed.heartbeat(parts[0], "station_id", "polled_at", FAR))
    got, state = run_in_groups(spark, parts, lambda s: keyed.cdc_stream(s, groups=3), "t-groups")
    assert shown(got) == want and state == 3


def test_vehicles_of_few_groups_equal_the_loop(spark):
    """Vehicles that share a group, some silent for whole runs, keep their own last kept rows."""
    rnd, rows = random.Random(8), []
    for v in range(25):
        lat, lon, reach, off = 37.7, -122.4, 9000, 0
        for m in range(0, 300, 5):
            lat, reach = lat + rnd.uniform(-1, 1) * 2e-4, reach - rnd.randrange(60)
            off = 1 - off if rnd.random() < 0.02 else off
            if v % 5 or not 90 < m < 220:
                rows.append((f"b{v}", at(m), lat, lon, reach, off, 0))
    df = spark.createDataFrame(rows, VEHICLES)
    time = F.col("observed_at")
    parts = [df.filter((time >= F.lit(at(a))) & (time < F.lit(at(a + 100)))) for a in (0, 100, 200)]
    parts[1] = parts[1].unionByName(parts[0].limit(50))  # some come twice
    parts.append(keyed.heartbeat(df, "bike_id", "observed_at", FAR))
    got, state = run_in_groups(spark, parts, lambda s: keyed.vehicle_stream(s, groups=2), "t-vgroups")
    assert sorted((r.bike_id, minute_of(r.observed_at)) for r in got.collect()) == loop(rows) and state == 2


def test_groups_grow_with_the_rows_that_wait():
    assert [keyed.groups_for(n, 24) for n in (0, 100_000, 6_000_000, 36_000_000)] == [24, 24, 367, 2198]


def test_slow_drift_is_emitted(spark):
    rows = [("v", at(i), 37.7 + i * 1e-4, -122.4, 100, 0, 0) for i in range(10)]  # 11 m a step
    got = cdc.cdc_threshold(spark.createDataFrame(rows, VEHICLES)).orderBy("observed_at").collect()
    assert [minute_of(r.observed_at) for r in got] == [0, 3, 6, 9]


def drifting(seed, n):
    """One vehicle that drifts for ever; no row is kept whatever came before it."""
    rnd = random.Random(seed)
    lat, reach, rows = 37.7, 90000, []
    for i in range(n):
        lat += rnd.choice([1e-4, 1e-4, 0.9e-4, 0, -1e-4] if seed else [1e-4])
        reach -= rnd.choice([0, 0, 40])
        rows.append(("v", at(i), lat, -122.4, reach, 0, 0))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_endless_drift_equals_the_loop_and_is_spread(spark, seed):
    """Seed 0 keeps every third row: histories from different first rows never meet."""
    rows = drifting(seed, 3000)
    df = spark.createDataFrame(rows, VEHICLES)
    got = cdc.cdc_threshold(df)
    assert sorted((r.bike_id, minute_of(r.observed_at)) for r in got.collect()) == loop(rows)
    slices = df.select(time_slices(df, "observed_at").alias("s")).groupBy("s").count().collect()
    assert len(slices) == 8 and max(r["count"] for r in slices) < 500
    plan = got._jdf.queryExecution().toString()
    assert "hashpartitioning(bike_id" in plan


def test_histories_for_all_first_rows():
    """Each speculated history is what the loop keeps when it begins there."""
    rnd = random.Random(5)
    for _ in range(30):
        n = rnd.randint(1, 60)
        lat = np.cumsum([rnd.choice([0, 1e-4, -1e-4, 5e-4]) for _ in range(n)]) + 37.7
        reach = np.array([rnd.randrange(0, 900) for _ in range(n)])
        flag = np.array([int(rnd.random() < 0.05) for _ in range(n)])
        rows = [lat, np.full(n, -122.4), reach, flag, np.zeros(n, int)]
        first = rnd.randint(1, n)
        kept, last = drift.histories(rows, first, MOVE_METERS, RANGE_METERS)
        for start in range(first):
            want = [start]
            for i in range(start + 1, n):
                if drift.far([c[want[-1]] for c in rows], [c[i : i + 1] for c in rows])[0]:
                    want.append(i)
            assert sorted(i for i, of in kept.items() if start in of) == want
            assert last[start] == want[-1]


def test_pieces_over_batches():
    frame = pd.DataFrame({"k": [1, 1, 1, 2, 3, 3], "s": [0, 0, 1, 1, 1, 1], "v": range(6)})
    for size in (1, 2, 3, 6):
        batches = [frame.iloc[i : i + size] for i in range(0, 6, size)]
        assert [p["v"].tolist() for p in drift.pieces(iter(batches), ["k", "s"])] == [[0, 1], [2], [3], [4, 5]]


def test_vehicle_rows_need_id_and_position(spark):
    raw = spark.createDataFrame(
        [("a", at(0), 1.0, 2.0, None, None, 1), ("", at(0), 1.0, 2.0, 5.9, 0, 0), (None, at(0), 1.0, 2.0, 5.0, 0, 0),
         ("b", at(0), None, 2.0, 5.0, 0, 0), ("c", at(0), 1.0, 2.0, 5.9, 0, None)],
        "bike_id string, observed_at timestamp, lat double, lon double, current_range_meters double, "
        "is_disabled int, is_reserved int",
    )
    got = sorted((r.bike_id, r.range_m, r.is_disabled, r.is_reserved) for r in cdc.vehicle_rows(raw).collect())
    assert got == [("a", 0, 0, 1), ("c", 5, 0, 0)]


def test_stream_insert_ignore(spark):
    src, out, log = (fresh_path(spark, f"t-up-{x}") for x in "abc")
    schema = "k string, t timestamp, v int"
    rows = [("a", at(0), 1), ("a", at(0), 2), ("b", at(1), 3)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    firsts = jobs.run_available(jobs.first_only(stream, ["k", "t"], "t"), "t-first", out, log)
    assert sorted(r.k for r in firsts.collect()) == ["a", "b"]


def snapshot(seconds, **bikes):
    stations = [
        {"station_id": s, "last_reported": 0, **dict.fromkeys(STATE_FIELDS, 1), "num_bikes_available": b}
        for s, b in bikes.items()
    ]
    return json.dumps({"last_updated": seconds, "data": {"stations": stations}})


def test_snapshot_files_to_change_log(spark, tmp_path):
    out, log = fresh_path(spark, "t-snap-out"), fresh_path(spark, "t-snap-log")
    base = 1_700_000_000
    polls = [dict(a=3, b=4), dict(a=3, b=5), dict(b=5, c=1), dict(a=2, b=5, c=1), {keyed.HEARTBEAT: 0}]
    for i, bikes in enumerate(polls):  # each poll lands, then the job runs once
        (tmp_path / f"poll{i}.json").write_text(snapshot(base + (120 if i < 4 else 7200) * i, **bikes) + "\n")
        rows = files.stream_snapshot_json(spark, str(tmp_path))
        got = jobs.run_available(keyed.cdc_stream(rows, time_col="feed_last_updated"), "t-snap", out, log)
    kept = sorted((r.station_id, r.num_bikes_available) for r in got.collect())
    assert kept == [("a", 2), ("a", 3), ("b", 4), ("b", 5), ("c", 1)]
    assert got.filter("last_reported IS NOT NULL").count() == 0


def test_many_short_histories_go_through_one_frame_and_equal_the_loop(spark):
    """Frames hold many vehicles, and a vehicle is whole: no work per vehicle and time range."""
    rnd = random.Random(9)
    rows = []
    for v in range(300):
        lat = 37.7
        for i in range(20):
            lat += rnd.choice([0, 1e-4, 2e-4])
            rows.append((f"v{v}", at(97 * i + v % 90), lat, -122.4, rnd.choice([0, 100, 200]), 0, int(rnd.random() < 0.1)))
    df = spark.createDataFrame(rows, VEHICLES)
    got = cdc.cdc_threshold(df)
    assert sorted((r.bike_id, minute_of(r.observed_at)) for r in got.collect()) == loop(rows)
    frame = pd.DataFrame({"bike_id": np.repeat(np.arange(50), 4), "slice": 0})
    batches = [frame.iloc[i : i + 30] for i in range(0, 200, 30)]
    found = list(drift.whole_pieces(iter(batches), ["bike_id", "slice"]))
    assert len(found) == 8 and sum(len(edges) for _, edges in found) == 50
    assert all(z - a == 4 and f["bike_id"].iloc[a] == f["bike_id"].iloc[z - 1] for f, edges in found for a, z in edges)
