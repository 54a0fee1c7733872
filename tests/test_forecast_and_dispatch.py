import random

import pytest
from helpers import at, demand_frame, grid_frame, minute_of
from pyspark.sql import functions as F

from pedalgrid.functions.scores import average_precision
from pedalgrid.functions.vehicles import meters
from pedalgrid.operators import dispatch, forecast
from pedalgrid.session import fresh_path


def ap_by_hand(rows):
    """Sum over distinct scores, best first, of recall gain times precision."""
    total = sum(y for _, y in rows)
    seen = hits = 0
    ap = 0.0
    for s in sorted({s for s, _ in rows}, reverse=True):
        at_s = [y for x, y in rows if x == s]
        seen, hits = seen + len(at_s), hits + sum(at_s)
        ap += sum(at_s) / total * hits / seen
    return ap


def test_average_precision_with_ties_and_a_hot_score(spark):
    rnd = random.Random(3)
    rows = [(0.0 if rnd.random() < 0.4 else rnd.randrange(200) / 7, int(rnd.random() < 0.3)) for _ in range(2000)]
    df = spark.createDataFrame([("g", s, y) for s, y in rows], "g string, s double, y int")
    got = average_precision(df, ["g"], "s", "y").first()
    assert (got.rows, got.positives) == (2000, sum(y for _, y in rows))
    assert got.ap == pytest.approx(ap_by_hand(rows), abs=1e-12)


def test_features_count_rows_not_minutes(spark):
    present = [i for i in range(60) if i % 10 != 3]  # missing buckets
    rows = [("A", i, 9, max(0, 40 - n), 1, True) for n, i in enumerate(present)]
    got = forecast.forecast_features(grid_frame(spark, rows), demand_frame(spark, ["A"]), [15, 240])
    by_h = {h: got.filter(F.col("horizon") == h).count() for h in (15, 240)}
    n = len(present)
    assert by_h == {15: n - 12 - 3, 240: max(0, n - 12 - 48)}
    r = got.orderBy("bucket").first()
    assert (r.flow_30m, r.flow_60m, r.starved_future) == (-6, -12, 0)
    assert got.agg(F.sum("starved_future")).first()[0] > 0


def test_split_is_chronological(spark):
    grid = grid_frame(spark, [("A", i, 1, 1, 1, True) for i in range(101)])
    rows = forecast.chrono_split(grid.select("bucket"), grid)
    first = rows.filter("is_test").agg(F.min("bucket")).first()[0]
    assert minute_of(first) == 350


def test_boosted_trees_beat_chance(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(1200):
        e = rnd.randrange(6)
        rows.append((60, at(5 * i), "A", e, 6, 6, i % 24, 0, 1.0, 0, 0, int(e + rnd.random() < 2), i >= 800))
    schema = (
        "horizon int, bucket timestamp, station_id string, ebikes int, bikes int, docks int, hour int, "
        "weekend int, demand double, flow_30m int, flow_60m int, starved_future int, is_test boolean"
    )
    rare = [(120, *r[1:11], int(i == 900), r[12]) for i, r in enumerate(rows)]
    table = spark.createDataFrame(rows + rare, schema).cache()
    folder = fresh_path(spark, "t-models")
    horizons = forecast.fit_models(table, folder, rounds=3)
    assert horizons == [60]  # the rare horizon has too few positives
    scored = forecast.score_models(table, folder, horizons)
    got = forecast.forecast_skill(scored, "m1").collect()
    assert [(r.horizon, r.test_rows, r.lift > 2) for r in got] == [(60, 400, True)]
    again = forecast.boosted_models(table, rounds=3)
    assert sorted(r.m1 for r in again.collect()) == sorted(r.m1 for r in scored.collect())
    reloaded = forecast.score_models(table, folder, horizons)
    assert sorted(r.m1 for r in reloaded.collect()) == sorted(r.m1 for r in scored.collect())
    report = forecast.model_report(scored).collect()
    assert [(r.horizon, r.test_rows) for r in report] == [(60, 400)]
    r = report[0]
    assert r.base_rate < r.ap_b0 <= 1 and 2 * r.base_rate < r.ap_m1 <= 1
    assert r.onset_rows < r.test_rows and r.lift_m1 == pytest.approx(r.ap_m1 / r.base_rate)
    assert [r.horizon for r in forecast.onset_skill(scored, "m1").collect()] == [60]


def test_onset_counts_all_test_rows(spark):
    """60 positives in the test period, one of them with stock: the horizon counts."""
    rows = [(15, at(i), "A", int(i == 0), 1, True, -float(i)) for i in range(60)]
    rows += [(15, at(60 + i), "A", 3, 0, True, -100.0) for i in range(20)]
    rows += [(30, at(i), "A", 1, int(i < 40), True, 0.0) for i in range(80)]
    scored = spark.createDataFrame(
        rows, "horizon int, bucket timestamp, station_id string, ebikes int, starved_future int, is_test boolean, b0 double"
    )
    got = forecast.onset_skill(scored).collect()
    assert [(r.horizon, r.test_rows) for r in got] == [(15, 21)]


SIZED = "bucket timestamp, station_id string, kind string, size double, expected double, lat double, lon double"


def city(spark, seed, n, spots):
    rnd = random.Random(seed)
    places = [(37.7 + rnd.random() * 0.3, -122.5 + rnd.random() * 0.4) for _ in range(spots)]
    rows = []
    for epoch in range(4):
        for i in range(n):
            lat, lon = places[i % spots]
            if rnd.random() < 0.5:
                rows.append((at(30 * epoch), f"S{i:03d}", "deficit", round(0.6 + rnd.random() * 6, 1), 1.0, lat, lon))
            else:
                rows.append((at(30 * epoch), f"S{i:03d}", "donor", round(2.2 + rnd.random() * 4, 1), 1.0, lat, lon))
    return rows, spark.createDataFrame(rows, SIZED).cache()


def minutes(a, b):
    return meters(a[5], a[6], b[5], b[6]) / 1000 / 18 * 60 + 6


def test_nearest_donor_equals_all_pairs(spark):
    rows, located = city(spark, 9, 50, 30)
    got = {(minute_of(r.bucket), r.station_id): r.donor_id for r in dispatch.nearest_donor(located).collect()}
    want = {}
    for s in (r for r in rows if r[2] == "deficit"):
        options = [(minutes(s, d), -d[3], d[1]) for d in rows if d[0] == s[0] and d[2] == "donor"]
        options = [o for o in options if o[0] <= 60]
        if options:
            want[(minute_of(s[0]), s[1])] = min(options)[2]
    assert got == want


def test_sizes_follow_the_rules(spark):
    rows = spark.createDataFrame(
        [(at(0), "a", 0, 0.5), (at(0), "b", 0, 0.51), (at(0), "c", 5, 2.0), (at(0), "d", 4, 1.5),
         (at(0), "e", 9, 0.05), (at(0), "f", 9, 0.5), (at(5), "a", 0, 9.0)],
        "bucket timestamp, station_id string, ebikes int, demand double",
    )
    epochs = dispatch.decision_epochs(rows)
    got = {r.station_id: (r.kind, round(r.size, 6)) for r in dispatch.deficits_donors(rows, epochs).collect()}
    assert got == {"b": ("deficit", 0.51), "c": ("donor", 3.0), "f": ("donor", 8.0)}


def test_trees_see_equal_rows_once_with_their_number(spark):
    rows = [(15, i % 3, 6, 6, i % 4, 0, float(i % 8), 0, 0, int(i % 3 == 0)) for i in range(4800)]
    schema = (
        "horizon int, ebikes int, bikes int, docks int, hour int, weekend int, demand double, flow_30m int, "
        "flow_60m int, starved_future int"
    )
    table = spark.createDataFrame(rows, schema)
    bins = forecast.demand_bins(table)
    held = forecast.weighted_rows(table, bins).collect()
    assert len(held) == 24 and sum(r.weight for r in held) == 4800
    assert all(r.weight == 200 for r in held)  # eight demands stay apart
    wide = forecast.demand_bins(spark.range(10_000).selectExpr("cast(id as double) demand"))
    sizes = wide.transform(spark.range(10_000).selectExpr("cast(id as double) demand")).groupBy("demand_bin").count()
    assert [abs(r["count"] - 10_000 / forecast.BINS) < 20 for r in sizes.collect()] == [True] * forecast.BINS
