import random

import pytest
from helpers import at, minute_of, poll_frame, status_frame
from pyspark.sql import functions as F

from pedalgrid.functions.timeutil import (
    ceil_bucket,
    epoch_to_ts,
    floor_bucket,
    with_local_clock,
)
from pedalgrid.operators import grid


def cells(df):
    return {(r.station_id, minute_of(r.bucket)): r for r in df.collect()}


def test_buckets_and_clock(spark):
    df = spark.createDataFrame([(at(0),), (at(4.999),), (at(5),)], "t timestamp")
    got = df.select(floor_bucket(F.col("t")).alias("f"), ceil_bucket(F.col("t")).alias("c")).collect()
    assert [(minute_of(r.f), minute_of(r.c)) for r in got] == [(0, 0), (0, 5), (5, 5)]
    old = spark.createDataFrame([(0,), (None,), (86400,)], "x bigint")
    assert [r[0] is None for r in old.select(epoch_to_ts(F.col("x"))).collect()] == [True, True, False]


def test_local_clock_across_dst_and_weekend(spark):
    utc = [
        ("2026-03-08 09:30:00", "weekend", 1),  # Sunday, just before the clock jumps
        ("2026-03-08 10:30:00", "weekend", 3),
        ("2026-11-01 08:30:00", "weekend", 1),
        ("2026-11-01 09:30:00", "weekend", 1),  # the hour that comes twice
        ("2026-03-07 07:59:00", "weekday", 23),  # still Friday there
        ("2026-03-07 08:00:00", "weekend", 0),
        ("2026-03-09 06:59:00", "weekend", 23),
        ("2026-03-09 07:00:00", "weekday", 0),
    ]
    df = spark.createDataFrame([(t,) for t, _, _ in utc], "s string")
    df = df.withColumn("bucket", F.col("s").cast("timestamp"))
    got = with_local_clock(df).select("s", "daytype", "hour").collect()
    assert [tuple(r) for r in got] == utc


def test_coverage_reaches_fifteen_minutes_inclusive(spark):
    polls = poll_frame(spark, [0, 60, 100.5]).unionByName(poll_frame(spark, [30], "error"))
    got = sorted(minute_of(r.bucket) for r in grid.bucket_coverage(polls).collect())
    assert got == [0, 5, 10, 15, 45, 50, 55, 60, 65, 70, 75, 90, 95, 100]
    assert grid.bucket_spine(polls).count() == 21


def test_no_good_poll_covers_nothing(spark):
    polls = poll_frame(spark, [0, 10], "error")
    assert grid.bucket_coverage(polls).count() == 0
    assert grid.bucket_spine(polls).count() == 0


def test_state_is_taken_at_bucket_start(spark):
    status = status_frame(
        spark,
        [
            ("A", -500, 1, 1, 9),  # long before the window
            ("A", 5, 2, 1, 8),  # exactly on a bucket
            ("A", 5.5, 3, 1, 7),
            ("A", 9, 4, 1, 6),  # replaced before the next bucket starts
            ("A", 9.5, 5, 1, 5),
            ("B", 7, 6, 1, 4),  # nothing before
            ("C", 900, 7, 1, 3),  # only after the window
        ],
    )
    covered = grid.bucket_coverage(poll_frame(spark, [0, 10, 17]))
    got = cells(grid.grid_status(status, covered))
    bikes = {k: r.num_bikes_available for k, r in got.items()}
    assert bikes == {
        ("A", 0): 1, ("A", 5): 2, ("A", 10): 5, ("A", 15): 5,
        ("B", 0): None, ("B", 5): None, ("B", 10): 6, ("B", 15): 6,
        ("C", 0): None, ("C", 5): None, ("C", 10): None, ("C", 15): None,
    }
    assert minute_of(got[("A", 15)].state_as_of) == 9.5
    assert got[("C", 5)].is_serving is None


def test_uncovered_gap_leaves_no_rows_but_state_carries_over(spark):
    covered = grid.bucket_coverage(poll_frame(spark, [0, 120]))
    got = cells(grid.grid_status(status_frame(spark, [("A", 0, 3, 1, 5)]), covered))
    assert sorted(m for _, m in got) == [0, 5, 10, 15, 105, 110, 115, 120]
    assert all(r.num_bikes_available == 3 for r in got.values())


def test_serving_is_three_valued(spark):
    status = status_frame(
        spark,
        [
            ("ok", 0, 3, 1, 5),
            ("stale", 0, 3, 1, 5, {"last_reported": at(-61)}),
            ("edge", 0, 3, 1, 5, {"last_reported": at(-60)}),
            ("silent", 0, 3, 1, 5, {"last_reported": None}),
            ("closed", 0, 3, 1, 5, {"last_reported": None, "renting": 0}),
            ("bare", 0, 3, None, 5),
        ],
    )
    got = cells(grid.grid_status(status, grid.bucket_coverage(poll_frame(spark, [0]))))
    flags = {s: (r.is_stale, r.is_serving) for (s, _), r in got.items()}
    assert flags == {
        "ok": (False, True),
        "stale": (True, False),
        "edge": (False, True),
        "silent": (None, None),
        "closed": (None, False),
        "bare": (False, True),
    }
    assert got[("bare", 0)].classic_available is None
    longer = grid.grid_status(status, grid.bucket_coverage(poll_frame(spark, [0, 10])))
    ages = {r.age_bin: r.cells for r in grid.fill_age_histogram(longer).collect()}
    assert ages == {"same bucket": 6, "5-15 min": 12, "15-60 min": 0, "> 1 hour": 0}


def test_hot_station_does_not_widen_the_grid(spark):
    rows = [("hot", i * 0.01, i % 9, 0, 1) for i in range(3000)] + [("cold", 3, 1, 1, 1)]
    covered = grid.bucket_coverage(poll_frame(spark, range(0, 31, 2)))
    segments = grid._segments(status_frame(spark, rows), covered, 5)
    assert segments.filter("station_id = 'hot'").count() == 7
    got = cells(grid.grid_status(status_frame(spark, rows), covered))
    assert got[("hot", 10)].num_bikes_available == 1000 % 9


@pytest.mark.parametrize("seed", [1, 2])
def test_grid_equals_looking_every_cell_up(spark, seed):
    rnd = random.Random(seed)
    polls = sorted({round(rnd.uniform(0, 240), 2) for _ in range(14)})
    log = sorted(
        {(rnd.choice("AAAAAB"), round(rnd.uniform(-60, 280) * 4) / 4) for _ in range(120)} | {("C", 300.0)}
    )
    status = status_frame(spark, [(s, m, i, i // 2, 9) for i, (s, m) in enumerate(log)])
    covered = grid.bucket_coverage(poll_frame(spark, polls))
    got = {k: r.num_bikes_available for k, r in cells(grid.grid_status(status, covered)).items()}

    first, last = int(polls[0] // 5) * 5, polls[-1]
    buckets = [b for b in range(first, 300, 5) if b <= last and any(abs(p - b) <= 15 for p in polls)]
    want = {}
    for b in buckets:
        for s in "ABC":
            before = [(m, i) for i, (k, m) in enumerate(log) if k == s and m <= b]
            want[(s, float(b))] = max(before)[1] if before else None
    assert got == want
    spine = grid.grid_spine(status, covered).collect()
    assert sorted((r.station_id, minute_of(r.bucket)) for r in spine) == sorted(want)
