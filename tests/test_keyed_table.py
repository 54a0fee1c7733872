"""Merge-on-read upserts and the poller's job: what is written, replays, restarts."""

import random

import pytest
from helpers import at, minute_of
from pyspark.sql.types import StructType

from pedalgrid.constants import STATE_FIELDS
from pedalgrid.operators import cdc
from pedalgrid.session import fresh_path
from pedalgrid.streaming import poll
from pedalgrid.streaming.keyed_table import KeyedTable

SCHEMA = StructType().add("k", "string").add("t", "timestamp").add("v", "integer")
SERIES = StructType().add("station_id", "string").add("polled_at", "timestamp")
for name in STATE_FIELDS:
    SERIES = SERIES.add(name, "short")


def table(spark, **options):
    return KeyedTable(spark, fresh_path(spark, "t-keyed"), SCHEMA, ["k"], "t", **options)


def batch(spark, rows):
    return spark.createDataFrame([(k, at(m), v) for k, m, v in rows], SCHEMA)


def content(df):
    return {r.k: (minute_of(r.t), r.v) for r in df.collect()}


def test_newest_row_wins_and_replays_change_nothing(spark):
    t = table(spark)
    assert content(t.read()) == {}
    assert t.apply(batch(spark, [("a", 0, 1), ("b", 1, 2)]), 0)
    assert t.apply(batch(spark, [("a", 5, 7), ("b", 0, 9), ("c", 2, None)]), 1)
    assert not t.apply(batch(spark, [("a", 99, 99)]), 1)
    assert t.apply(batch(spark, [("a", 5, 8)]), 2)  # of equal times the later batch's
    assert content(t.read()) == {"a": (5, 8), "b": (1, 2), "c": (2, None)}
    assert content(t.read(1))["a"] == (5, 7)
    with pytest.raises(ValueError):
        t.read(0)  # expired


def test_a_batch_touches_its_buckets_only(spark):
    t = table(spark, buckets=8, most_deltas=3)
    t.apply(batch(spark, [(f"k{i}", 0, i) for i in range(400)]), 0)
    first = {e["bucket"]: e["bytes"] for e in t.manifest(0)}
    assert len(first) == 8
    for version in (1, 2, 3, 4):
        t.apply(batch(spark, [("k7", version, version)]), version)
        entries = t.manifest(version)
        new = [e for e in entries if e["version"] == version]
        assert len({e["bucket"] for e in new}) == 1  # the others keep their files
        assert all(sum(e["bucket"] == b for e in entries) <= 4 for b in first)
    touched = {e["bucket"] for e in t.manifest(4) if e["version"] > 0}
    assert len(touched) == 1
    assert any(e["base"] for e in t.manifest(4) if e["bucket"] in touched)  # rewritten once
    assert content(t.read())["k7"] == (4, 4) and t.read().count() == 400


def test_files_of_old_versions_go(spark):
    t = table(spark, buckets=2, most_deltas=2, keep=2)
    for version in range(9):
        t.apply(batch(spark, [(f"k{i}", version, version) for i in range(20)]), version)
    assert t.versions() == [7, 8]
    named = {(e["base"], e["version"]) for v in t.versions() for e in t.manifest(v)}
    for base in (True, False):
        found = {int(e.getPath().getName()[1:]) for e in t._list(f"{t.folder}/{'base' if base else 'delta'}")}
        assert found == {v for b, v in named if b == base}


def test_a_batch_that_broke_off_is_written_over(spark, monkeypatch):
    t = table(spark)
    t.apply(batch(spark, [("a", 0, 1)]), 0)
    t._write(batch(spark, [("a", 9, 9), ("z", 9, 9)]).selectExpr("*", "1L AS _version"), False, 1)  # no manifest
    assert content(t.read()) == {"a": (0, 1)}
    t.apply(batch(spark, [("a", 2, 2)]), 1)
    assert content(t.read()) == {"a": (2, 2)}


def series(spark, rows):
    return spark.createDataFrame([(s, at(m), v, 0, 0, 5, 0, 1, 1, 1) for s, m, v in rows], SERIES)


def polls_of(seed, n):
    rnd = random.Random(seed)
    return [(s, 2 * m, rnd.choice([1, 1, 2, None])) for m in range(n) for s in "ABC" if rnd.random() < 0.8]


def expected(spark, rows):
    flags = cdc.cdc_flags(series(spark, rows))
    log = {}
    for r in flags.collect():
        seen, written = log.get(minute_of(r.polled_at), (0, 0))
        log[minute_of(r.polled_at)] = seen + 1, written + r.changed
    return rows_of(flags.filter("changed")), rows_of(cdc.cdc_latest(flags.filter("changed"))), log


def rows_of(df):
    return sorted(((r.station_id, minute_of(r.polled_at), r.num_bikes_available) for r in df.collect()), key=repr)


def state_of(tables):
    log = {minute_of(r.polled_at): (r.stations_seen, r.rows_written) for r in tables.polls().collect()}
    assert all(r.unchanged == r.stations_seen - r.rows_written for r in tables.polls().collect())
    return rows_of(tables.changes()), rows_of(tables.current()), log


def run(spark, tables, feed, parts):
    for part in parts:
        series(spark, part).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(SERIES).parquet(feed)
        metrics = poll.run_polls(stream, tables)
    return metrics


def test_poll_job_equals_the_batch_and_observes(spark):
    rows = polls_of(1, 12)
    parts = [[r for r in rows if a <= r[1] < a + 8] for a in (0, 8, 16)]
    parts[2] += parts[1][-3:]  # delivered again
    tables = poll.PollTables(spark, fresh_path(spark, "t-poll"), SERIES)
    assert state_of(tables) == ([], [], {})
    metrics = run(spark, tables, fresh_path(spark, "t-poll-feed"), parts)
    assert state_of(tables) == expected(spark, rows)
    assert [m["poll"]["rows_seen"] for _, m in metrics.seen] == [len(parts[2])]
    total = tables.ledger().groupBy().sum("rows_seen", "rows_written").first()
    assert total[0] >= len(rows) and total[1] == tables.changes().count()


@pytest.mark.parametrize("broken", ["state", "polls", "ledger"])
def test_a_crash_between_two_sinks_leaves_all_of_them_consistent(spark, broken, monkeypatch):
    rows = polls_of(2, 8)
    first, second = [r for r in rows if r[1] < 8], [r for r in rows if r[1] >= 8]
    tables = poll.PollTables(spark, fresh_path(spark, "t-crash"), SERIES)
    feed = fresh_path(spark, "t-crash-feed")
    run(spark, tables, feed, [first])
    before = state_of(tables)
    assert before == expected(spark, first)

    with monkeypatch.context() as patch:
        def fail(*_args, **_kwargs):
            raise RuntimeError("lost")

        if broken == "state":
            patch.setattr(KeyedTable, "apply", fail)
        elif broken == "polls":  # the state is written already
            done = KeyedTable.apply
            patch.setattr(KeyedTable, "apply", lambda self, b, i: (done(self, b, i), fail()))
        else:
            patch.setattr(poll.PollTables, "_commit", fail)
        with pytest.raises(Exception):
            run(spark, tables, feed, [second])
    assert state_of(tables) == before
    run(spark, tables, feed, [[]])
    assert state_of(tables) == expected(spark, rows)
