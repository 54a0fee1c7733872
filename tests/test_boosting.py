"""Boosted trees: the ones Spark's own trainer finds, in one stage per horizon whatever the rounds, rows and tasks."""

import random

import numpy as np
import pytest
from helpers import at
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pedalgrid.functions import boosting
from pedalgrid.operators import forecast
from pedalgrid.session import fresh_path

SCHEMA = (
    "horizon int, bucket timestamp, station_id string, ebikes int, bikes int, docks int, hour int, "
    "weekend int, demand double, flow_30m int, flow_60m int, starved_future int, is_test boolean"
)


@pytest.fixture(scope="module")
def rows(spark):
    rnd, made = random.Random(11), []
    for i in range(12_000):  # few values, and none that follows from others: hardly two splits gain the same
        e, bikes, docks, hour, weekend, d, flow, longer = (rnd.randrange(n) for n in (9, 4, 5, 6, 2, 16, 5, 4))
        for horizon in (15, 60):
            starved = int(e - d / 4 + flow / 3 - bikes / 5 + hour / 7 + rnd.gauss(0, horizon / 20) < 0)
            made.append((horizon, at(5 * i), f"S{i % 7}", e, bikes, docks, hour, weekend, d / 3, flow - 2, longer - 1, starved, i >= 10_000))
    return spark.createDataFrame(made, SCHEMA).cache()


def by_spark(rows, rounds):
    """m1 of the test rows by Spark's trainer, on the same counted rows. All features are numbers: without its
    metadata the demand range is in order too, no mere name."""
    past = rows.filter("NOT is_test")
    bins = forecast.demand_bins(past)
    assembler = VectorAssembler(inputCols=forecast.FEATURES, outputCol="features")
    trees = GBTClassifier(labelCol="starved_future", weightCol="weight", maxIter=rounds, maxBins=32)
    counted = forecast.weighted_rows(past, bins).withColumn("demand_bin", F.col("demand_bin") + 0)
    model = trees.fit(assembler.transform(counted))
    scored = model.transform(assembler.transform(bins.transform(rows.filter("is_test"))))
    return scored.select("bucket", vector_to_array("probability")[1].alias("m1"))


def sorted_scores(scored):
    return [r.m1 for r in scored.orderBy("bucket").collect()]


def test_trees_are_those_of_the_library(spark, rows):
    folder = fresh_path(spark, "t-trees")
    scored = forecast.score_models(rows, folder, forecast.fit_models(rows, folder, rounds=8))
    for horizon in (15, 60):
        one = F.col("horizon") == horizon
        want = sorted_scores(by_spark(rows.filter(one), 8))
        assert sorted_scores(scored.filter(one)) == pytest.approx(want, abs=1e-9)
        assert len(set(want)) > 100


def test_rows_spread_over_tasks(spark, rows, monkeypatch):
    """More rows than a task holds: the same trees as in one."""
    scores = []
    for held in (1 << 21, 1500):
        monkeypatch.setattr(forecast, "FIT_ROWS", held)
        folder = fresh_path(spark, "t-spread")
        scored = forecast.score_models(rows, folder, forecast.fit_models(rows, folder, rounds=5))
        scores.append([r.m1 for r in scored.orderBy("horizon", "bucket").collect()])
    assert scores[0] == pytest.approx(scores[1], abs=1e-9)


def test_rounds_cost_no_jobs(spark, rows):
    """Before, each round was some six jobs per horizon."""
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    counts = []
    for rounds in (2, 12):
        before = jobs()
        forecast.fit_models(rows, fresh_path(spark, "t-rounds"), rounds=rounds)
        counts.append(jobs() - before)
    assert counts[0] == counts[1]


def test_horizons_are_scored_in_one_pass(spark, rows):
    """Before, the report read the rows once per horizon."""
    folder = fresh_path(spark, "t-pass")
    horizons = forecast.fit_models(rows, folder, rounds=2)
    assert horizons == [15, 60]
    scored = forecast.score_models(rows, folder, horizons)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") == 1
    report = {r.horizon: r for r in forecast.model_report(scored).collect()}
    assert set(report) == {15, 60} and all(r.test_rows == 2000 and r.lift_m1 > 1 for r in report.values())


def test_ranges_of_features(spark):
    made = [(i % 3 * 10, i % 100, 1) for i in range(3000)]
    train = spark.createDataFrame(made, "ebikes int, bikes int, weight int").withColumns(
        {f: F.lit(1) for f in forecast.FEATURES if f not in ("ebikes", "bikes")}
    )
    cuts = forecast.feature_cuts(train)
    assert cuts["ebikes"] == [5.0, 15.0] and cuts["hour"] == []
    sizes = np.bincount(np.searchsorted(cuts["bikes"], np.arange(100)))
    assert len(sizes) == forecast.BINS and sizes.max() <= 4


def test_equal_rows_are_one_with_their_weight():
    rng = np.random.default_rng(2)
    sizes = [3, 5, 2]
    ranges = np.stack([rng.integers(0, s, 4000) for s in sizes], axis=1).astype(np.uint8)
    label = (rng.random(4000) < ranges[:, 0] / 3).astype(np.uint8)
    whole = boosting.fit_trees(ranges, label, np.ones(4000), sizes, 4)
    counted = boosting.merged(ranges, label, np.ones(4000))
    assert len(counted[1]) <= 60 and counted[2].sum() == 4000
    few = boosting.fit_trees(*counted, sizes, 4)
    assert boosting.score_trees(ranges, *whole) == pytest.approx(boosting.score_trees(ranges, *few), abs=1e-9)
    each = [boosting.score_trees(ranges[i : i + 1], *few)[0] for i in range(50)]
    assert boosting.score_trees(ranges, *few, rows=7)[:50] == pytest.approx(each, abs=0)


def test_nothing_to_learn():
    """No rows, or one class: no split, no division by zero."""
    none = boosting.fit_trees(np.zeros((0, 2), np.uint8), np.zeros(0, np.uint8), np.zeros(0), [2, 2], 2)
    assert boosting.score_trees(np.zeros((1, 2), np.uint8), *none).tolist() == [0.5]
    one = boosting.fit_trees(np.array([[0, 1], [1, 0]], np.uint8), np.ones(2, np.uint8), np.ones(2), [2, 2], 3)
    assert boosting.score_trees(np.array([[0, 1], [1, 1]], np.uint8), *one).min() > 0.8
    assert len(boosting.score_trees(np.zeros((0, 2), np.uint8), *one)) == 0


def some_trees(rows=3000, rounds=6):
    rng = np.random.default_rng(5)
    sizes = [7, 32, 2, 5]
    ranges = np.stack([rng.integers(0, s, rows) for s in sizes], axis=1).astype(np.uint8)
    label = (rng.random(rows) < (ranges[:, 0] + ranges[:, 1] / 4) / 15).astype(np.uint8)
    return sizes, ranges, label, boosting.fit_trees(ranges, label, np.ones(rows), sizes, rounds)


def test_leaves_by_bits_are_those_of_the_walk():
    _, ranges, _, (feature, upto, value) = some_trees()
    want = []
    for row in ranges[:400].tolist():
        margin = 0.0
        for f, u, v in zip(feature.tolist(), upto.tolist(), value.tolist(), strict=True):
            node = 0
            while node < boosting.NODES:
                node = 2 * node + 1 + (row[f[node]] > u[node])
            margin += v[node - boosting.NODES]
        want.append(1 / (1 + np.exp(-2 * margin)))
    assert len(set(want)) > 50
    tables = boosting.leaf_tables(feature, upto)
    assert boosting.score_leaves(ranges[:400], tables, value, rows=33) == pytest.approx(want, abs=1e-12)


def test_a_level_counts_half_of_the_rows_at_most(monkeypatch):
    """Before, each level of each tree counted all of them."""
    counted, count = [], boosting.Sums.count

    def watched(self, node, width, rows, weight, pull):
        counted.append(len(weight[rows]))
        return count(self, node, width, rows, weight, pull)

    monkeypatch.setattr(boosting.Sums, "count", watched)
    sizes, ranges, label, first = some_trees()
    assert counted.count(len(label)) == 6  # the root of each tree
    assert sorted(counted)[-7] <= len(label) / 2 and len(counted) == 6 * boosting.DEPTH
    for level in range(boosting.DEPTH):  # the sums are those of counting all rows
        width = 1 << level
        node = np.random.default_rng(level).integers(0, width, len(label))
        sums = boosting.Sums(ranges, sizes)
        before = count(sums, node >> 1, max(width // 2, 1), slice(None), np.ones(len(label)), label * 1.0) if level else None
        got = sums.next_level(before, node, width, np.ones(len(label)), label * 1.0)
        for a, b in zip(got, count(sums, node, width, slice(None), np.ones(len(label)), label * 1.0), strict=True):
            assert a == pytest.approx(b, abs=1e-9)
