import math

import pytest
from helpers import at, grid_frame
from pyspark.sql import functions as F

from pedalgrid.functions.poisson import surprise_threshold
from pedalgrid.operators import calibrate, deltas

DELTA = (
    "bucket timestamp, station_id string, d_bikes smallint, d_ebikes smallint, d_classic smallint, "
    "d_docks smallint, d_disabled smallint, bikes smallint, docks smallint, carried_forward boolean"
)


def labelled(spark, rows):
    full = [(at(5 * i), "A", d, 0, 0, k, 0, 5, 5, c) for i, (d, k, c) in enumerate(rows)]
    df = spark.createDataFrame(full, DELTA)
    return df.withColumn("event_class", deltas.event_class(F.lit(5), F.lit(5), 5))


def test_first_rule_wins_and_unknown_docks_skip_the_artifact(spark):
    got = labelled(
        spark,
        [(7, -7, True), (7, -5, False), (7, -6, False), (-6, 6, False), (4, 9, False), (0, 9, False), (-8, None, False)],
    )
    assert [r.event_class for r in got.orderBy("bucket").collect()] == [
        "no_observation", "feed_artifact", "inferred_truck_dropoff", "inferred_truck_pickup",
        "rider_churn", "idle", "inferred_truck_pickup",
    ]


def test_delta_bridges_an_uncovered_gap(spark):
    grid = grid_frame(
        spark, [("A", 0, None, None, None, None), ("A", 1, 5, 2, 5, True), ("A", 40, 3, 2, 7, True)]
    )
    got = deltas.station_deltas(grid).collect()
    assert [(r.d_bikes, r.d_classic, r.d_docks, r.event_class) for r in got] == [(-2, -2, 2, "rider_churn")]


def test_gap_latency_picks_by_index(spark):
    buckets = [0, 0, 1, 3, 6, 10, 30]  # gaps 5, 10, 15, 20, 100 minutes
    rows = [(at(5 * b), f"S{i}", 6, 0, 0, -6, 0, 5, 5, False) for i, b in enumerate(buckets)]
    df = spark.createDataFrame(rows, DELTA).withColumn("event_class", F.lit("inferred_truck_dropoff"))
    got = deltas.van_gap_latency(df).collect()[0]
    assert tuple(got) == (5, 5, 15, 100, 100)
    assert deltas.van_gap_latency(df.filter("false")).count() == 0


def test_sweep_never_grows_with_the_threshold(spark):
    df = labelled(spark, [(d, -d, False) for d in range(-12, 13)])
    counts = [r.events for r in deltas.van_threshold_sweep(df).orderBy("threshold").collect()]
    assert counts == sorted(counts, reverse=True) and counts[0] == 20


def by_hand(lam, alpha=1e-4, floor=3, cap=60):
    """Exact tail by summing the upper masses."""
    if lam <= 0:
        return floor
    for k in range(1, cap):
        logs = [j * math.log(lam) - lam - math.lgamma(j + 1) for j in range(k, k + 4000)]
        if math.fsum(math.exp(x) for x in logs) < alpha:
            return max(k, floor)
    return cap


@pytest.mark.parametrize("lam", [0.0, 1e-9, 0.02, 0.5, 1.0, 3.3, 12.0, 30.0, 33.0, 40.0, 700.0, 800.0])
def test_threshold(spark, lam):
    got = spark.createDataFrame([(lam,)], "lam double").select(surprise_threshold(F.col("lam"))).first()[0]
    assert got == by_hand(lam)


def test_calibration_settles_and_stays(spark):
    rows, state = [], 20
    for i in range(600):
        step = -9 if i % 97 == 50 else 9 if i % 97 == 55 else (-1 if i % 2 else 1)
        state = max(1, min(39, state + step))
        rows.append(("A", i, state, state // 2, 40 - state, True))
    grid = grid_frame(spark, rows)
    first = deltas.station_deltas(grid)
    done = calibrate.calibrate_vans(grid, first)
    assert done.converged
    again = calibrate.calibrate_vans(grid, done.deltas)
    assert [r.changed for r in again.rounds.collect()] == [0]
    assert done.deltas.columns == first.columns
    vans = done.deltas.filter(deltas.is_van()).count()
    assert vans == done.rounds.orderBy(F.desc("round")).first().vans
