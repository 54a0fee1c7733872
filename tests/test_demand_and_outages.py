import random

import pytest
from helpers import at, demand_frame, grid_frame
from pyspark.sql import functions as F

from pedalgrid.operators import deltas, demand, health, outages
from pedalgrid.plans.fleet import fleet
from pedalgrid.session import fresh_path


def test_exposure_is_three_valued(spark):
    grid = grid_frame(
        spark,
        [
            ("A", 0, 5, 0, 5, None),  # empty and unknown: no
            ("A", 1, 5, 2, 5, None),  # stocked and unknown: unknown
            ("A", 2, 5, 2, 5, True),
            ("A", 3, 5, 2, 5, False),
            ("A", 4, 5, 2, 5, True),
        ],
    )
    got = demand.exposure(grid).orderBy("bucket").collect()
    assert [r.ebike_exposed for r in got] == [None, False, None, True, False]


def test_never_stocked_cell_has_no_rate(spark):
    grid = grid_frame(spark, [("A", i, 3, 0, 5, True) for i in range(13)])
    cells = demand.demand_cells(demand.demand_observations(grid, deltas.station_deltas(grid)))
    rows = demand.demand_baseline(cells).collect()
    assert sum(r.total_buckets for r in rows) == 12
    assert all(r.ebike_obs is None and r.ebike_demand_per_hour is None and r.low_confidence for r in rows)


def test_rates_shrink_to_the_station(spark):
    cells = spark.createDataFrame(
        [("A", "weekday", 8, 100, 90, 45, 50, 5), ("A", "weekday", 3, 100, 10, 0, 50, 5)],
        "station_id string, daytype string, hour int, total_buckets bigint, "
        "ebike_exposed_buckets bigint, ebike_obs bigint, classic_exposed_buckets bigint, classic_obs bigint",
    )
    got = {r.hour: r for r in demand.demand_baseline(cells).collect()}
    prior = 45 / 100
    assert got[8].ebike_rate_per_bucket == pytest.approx((45 + 12 * prior) / 102)
    assert got[3].ebike_demand_per_hour == pytest.approx(12 * (12 * prior) / 22)
    assert got[3].ebike_latent_total == pytest.approx(100 * (12 * prior) / 22)
    assert (got[8].low_confidence, got[3].low_confidence) == (False, True)


def test_runs_break_on_state_not_on_time(spark):
    grid = grid_frame(
        spark,
        [("A", 0, 3, 0, 0, True), ("A", 1, 3, 0, 5, True), ("A", 9, 3, 0, 5, True),
         ("A", 10, 3, 1, 5, True), ("A", 11, 3, 0, 5, False), ("A", 12, 3, 0, 5, True)],
    )
    runs = outages.outage_runs(outages.outage_islands(outages.outage_flags(grid, demand_frame(spark, ["A"], 2.4))))
    got = {(r.kind, r.minutes): r for r in runs.collect()}
    assert set(got) == {("starvation", 15), ("starvation", 5), ("saturation", 5)}
    assert got[("starvation", 15)].lost_trips == pytest.approx(0.6)
    assert got[("saturation", 5)].lost_trips is None
    assert [(r.kind, r.minutes) for r in outages.outage_events(runs).collect()] == [("starvation", 15)]


def test_station_without_demand_is_no_outage(spark):
    grid = grid_frame(spark, [("A", i, 3, 0, 5, True) for i in range(6)])
    flags = outages.outage_flags(grid, demand_frame(spark, ["B"]))
    runs = outages.outage_runs(outages.outage_islands(flags))
    assert runs.count() == 1 and outages.outage_events(runs).count() == 0


def test_concentration_with_ties(spark):
    events = spark.createDataFrame(
        [("starvation", s, m) for s, m in [("A", 60), ("B", 30), ("C", 30), ("D", 30), ("E", 10)]],
        "kind string, station_id string, minutes bigint",
    )
    grid = spark.createDataFrame([(f"S{i}",) for i in range(10)], "station_id string")
    got = outages.outage_concentration(events, grid).collect()
    # A reaches 37 %; B, C and D share 94 %, so the first of them is rank 2
    assert [(r.target, r.stations, r.network_share) for r in got] == [(0.25, 1, 0.1), (0.5, 2, 0.2), (0.8, 2, 0.2)]


def test_duration_sweep_is_monotone(spark):
    runs = spark.createDataFrame(
        [("starvation", 5 * i, 0.5 * i, 1.0) for i in range(1, 20)] + [("starvation", 500, 9.0, None)],
        "kind string, minutes bigint, lost_trips double, demand_per_hour double",
    )
    got = outages.outage_duration_sweep(runs).orderBy("min_minutes").collect()
    assert [r.events for r in got] == [19, 18, 17, 14, 8]


def test_health_compares_stock_with_demand(spark):
    grid = grid_frame(spark, [("A", 0, 5, 1, 5, True), ("A", 1, 5, 2, 5, True), ("A", 2, 5, 0, 5, None)])
    got = health.station_health(grid, demand_frame(spark, ["A"], 2.0)).orderBy("bucket").collect()
    assert [(r.healthy_old, r.healthy_new, r.falsely_healthy) for r in got] == [
        (True, False, True), (True, True, False), (False, False, False)]
    shares = health.health_shares(health.station_health(grid, demand_frame(spark, ["A"], 2.0))).first()
    assert shares.cells == 3 and shares.healthy_old == pytest.approx(2 / 3)


def test_demand_reads_the_calibrated_labels(spark):
    """Not the labels of the fixed threshold, from which it would differ."""
    f = fleet(spark, "/root/testdata/sf0.01")

    def seen(cells):
        return cells.selectExpr("sum(ebike_obs)", "sum(classic_obs)").first()

    def of(labels):
        return seen(demand.demand_cells(demand.demand_observations(f.grid, labels)))

    assert seen(f.cells) == of(f.calibrated) != of(f.deltas)
    assert f.demand.selectExpr("sum(ebike_observed_total)").first()[0] == 7467


def test_sketches_merge_and_a_month_replaces_its_own(spark):
    """Months in any split: exact counters, quantiles within their stated rank, stations within a few percent."""
    rnd = random.Random(7)
    rows = [
        (rnd.choice(["starvation", "saturation"]), f"S{rnd.randrange(800)}", at(60 * rnd.randrange(2000)), 5 * int(rnd.expovariate(0.05)) + 15, 1.0)
        for _ in range(8000)
    ]
    events = spark.createDataFrame(rows, "kind string, station_id string, started_at timestamp, minutes int, lost_trips double")
    path = fresh_path(spark, "t-sketches")
    cut = F.col("started_at") < F.lit("2024-05-01").cast("timestamp")
    outages.store_outage_sketches(events.filter(cut).limit(10), path)  # an unfinished load of these months
    for part in (events.filter(cut), events.filter(~cut)):
        stored = outages.store_outage_sketches(part, path)
    assert stored.select("month").distinct().count() >= 3
    exact = {r["kind"]: r for r in outages.outage_stats(events).collect()}
    for r in outages.merged_outage_stats(stored).collect():
        known = exact[r["kind"]]
        assert all(r[c] == known[c] for c in ("events", "max_minutes", "lost_trips"))
        assert abs(r["stations"] / known["stations"] - 1) < 0.05
        own = sorted(x[3] for x in rows if x[0] == r["kind"])
        for name, rank in (("median_minutes", 0.5), ("p90_minutes", 0.9)):
            below, upto = (sum(m < r[name] for m in own) / len(own), sum(m <= r[name] for m in own) / len(own))
            assert below <= rank + 0.01 and upto >= rank - 0.01
