"""Sliced computations equal plain windows, also when one key holds most rows."""

import bisect
import random

import pytest
from helpers import at
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pedalgrid.functions.ordered import (
    global_index,
    running_totals,
    slice_bounds,
    slice_of,
    sliced_lag,
    sliced_row_number,
    value_ranks,
)


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    minutes = rnd.sample(range(100_000), 900)
    data = [
        ("hot" if i % 3 else f"k{i % 40}", at(m), m, rnd.choice([None, 1, 2]))
        for i, m in enumerate(minutes)
    ]
    return spark.createDataFrame(data, "key string, t timestamp, m int, v int").cache()


def test_slices_are_even_and_ordered(rows):
    bounds = slice_bounds(rows, F.col("m"), 8)
    sizes = rows.groupBy(slice_of(F.col("m"), bounds).alias("s")).agg(
        F.count("*").alias("n"), F.min("m").alias("lo"), F.max("m").alias("hi")
    )
    got = sizes.orderBy("s").collect()
    assert len(got) == 8
    assert all(abs(r.n - 900 / 8) < 20 for r in got)
    assert all(a.hi < b.lo for a, b in zip(got, got[1:]))


def test_row_number(rows):
    bounds = slice_bounds(rows, F.col("m"), 6)
    for desc in (False, True):
        order = F.desc("m") if desc else F.asc("m")
        sliced = sliced_row_number(rows, ["key"], slice_of(F.col("m"), bounds), [order], "rn", desc)
        plain = rows.withColumn("rn", F.row_number().over(W.partitionBy("key").orderBy(order)))
        assert sorted(sliced.select("m", "rn").collect()) == sorted(plain.select("m", "rn").collect())


def test_lag_keeps_null_states_apart_from_no_row(rows):
    got = sliced_lag(rows, ["key"], "t", ["v"]).select("m", "prev.v", F.col("prev").isNull().alias("first"))
    w = W.partitionBy("key").orderBy("t")
    want = rows.select("m", F.lag("v").over(w).alias("v"), (F.row_number().over(w) == 1).alias("first"))
    key = lambda r: r.m
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_lag_without_keys(rows):
    got = sliced_lag(rows, [], "t", ["m"]).select("m", F.col("prev.m").alias("p"))
    want = rows.select("m", F.lag("m").over(W.orderBy("t")).alias("p"))
    key = lambda r: r.m
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_running_totals(rows):
    steps = rows.groupBy("key", (F.col("m") % 97).alias("x")).agg(F.count("*").alias("n"))
    for desc in (False, True):
        got = running_totals(steps, ["key"], "x", ["n"], desc, slices=5)
        w = W.partitionBy("key").orderBy(F.desc("x") if desc else F.asc("x"))
        want = steps.withColumn("cum_n", F.sum("n").over(w))
        cols = ["key", "x", "cum_n"]
        assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_value_ranks_with_ties(rows):
    some = rows.withColumn("x", F.col("m") % 7)
    for desc in (False, True):
        ranks = value_ranks(some, "x", "r", desc)
        got = some.join(ranks, "x").select("m", "r")
        order = F.desc("x") if desc else F.asc("x")
        want = some.select("m", F.rank().over(W.orderBy(order)).alias("r"))
        assert sorted(got.collect()) == sorted(want.collect())


def test_global_index(rows):
    got = global_index(rows.select("m"), ["m"]).orderBy("m").collect()
    assert [r.idx for r in got] == list(range(900))


def test_many_slices_compile(spark):
    """As many cut points as a large cluster has partitions: no oversized code, same places."""
    rows = spark.range(5000).select((F.col("id") * 7919 % 100_003).alias("m"))
    bounds = sorted({(i * 48) % 100_003 for i in range(1, 2048)})
    got = rows.select("m", slice_of(F.col("m"), bounds).alias("s"), slice_of(F.lit(None).cast("long"), bounds).alias("n"))
    assert all(r.s == bisect.bisect_right(bounds, r.m) and r.n == len(bounds) for r in got.collect())
    code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(
        got._jdf.queryExecution().executedPlan()
    )
    assert all(len(code.apply(i)._2()) < 64_000 for i in range(code.size()))
