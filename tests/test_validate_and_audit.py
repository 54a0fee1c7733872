from helpers import at, minute_of, poll_frame

from pedalgrid.operators import audit, freshness, validate

PAIRS = "station_id string, short_name string, est double, obs double"


def test_constant_side_has_no_correlation(spark):
    pairs = spark.createDataFrame([(str(i), str(i), 1.0, float(i)) for i in range(5)], PAIRS)
    assert validate.pearson(pairs).first().pearson is None
    assert validate.rank_corr(pairs).first().rank_corr is None


def test_ranks_share_the_lowest_on_ties(spark):
    est = [9.0, 8.0, 8.0, 7.0] + [1.0] * 30
    pairs = spark.createDataFrame([(str(i), f"n{i:02d}", e, float(i)) for i, e in enumerate(est)], PAIRS)
    got = validate.top_rank_disagreement(pairs).collect()
    assert [r.rank_grid for r in got] == [1, 2, 2, 4] + [5] * 30
    assert [r.rank_trips for r in got][:4] == [34, 33, 32, 31]
    assert got[0].disagree and not got[33].disagree


def test_coverage_and_gate(spark):
    polls = poll_frame(spark, range(0, 60, 2)).unionByName(poll_frame(spark, [61, 66], "error"))
    cov = audit.bucket_coverage_pct(polls).first()
    assert (cov.covered, cov.expected) == (12, 14)
    assert audit.coverage_gate(audit.bucket_coverage_pct(polls)).first().gate == "not yet"
    week = poll_frame(spark, range(0, 7 * 1440 + 1, 5))
    assert audit.coverage_gate(audit.bucket_coverage_pct(week)).first().gate == "passed"
    holes = poll_frame(spark, [m for m in range(0, 8 * 1440, 5) if m % 100])
    assert audit.coverage_gate(audit.bucket_coverage_pct(holes)).first().gate == "failed"


def test_longest_gap_is_the_earliest_of_equals(spark):
    polls = poll_frame(spark, [0, 10, 30, 35, 55]).unionByName(poll_frame(spark, [20, 45], "error"))
    got = audit.longest_gap(polls).first()
    assert (got.gap_seconds, minute_of(got.started_at)) == (1200.0, 10)
    assert audit.longest_gap(poll_frame(spark, [3])).count() == 0


def test_errors_and_since(spark):
    polls = poll_frame(spark, range(0, 20, 2), "error").unionByName(poll_frame(spark, [1, 3]))
    got = audit.poll_errors(polls).collect()
    assert [minute_of(r.polled_at) for r in got] == [18, 16, 14, 12, 10]
    assert (got[0].polls_ok, got[0].polls_error) == (2, 10)
    assert audit.since_filter(polls, start="2024-03-04 12:10:00").count() == 5
    assert audit.since_filter(polls, days=1).count() == 0


def test_missing_table_resets_the_chain(spark):
    def table(*minutes):
        return spark.createDataFrame([(at(m),) for m in minutes], "t timestamp")

    chain = [("a", table(0, 500), "t"), ("b", table(400), "t"), ("c", table(), "t"), ("d", table(5), "t"), ("e", table(6), "t")]
    got = freshness.freshness_check(chain).collect()
    assert [(r.state, r.lag_minutes) for r in got] == [
        ("ok", 0.0), ("STALE", 100.0), ("MISSING", None), ("ok", 0.0), ("ok", -1.0)]
    lag = freshness.source_lag(table(500), table(400), "t").first()
    assert round(lag.hours_behind, 6) == 1.666667 and lag.stale


def test_absent_table_is_missing(spark):
    from pedalgrid.operators.freshness import freshness_check

    there = spark.range(1).selectExpr("timestamp'2024-01-01 00:00:00' AS t")
    got = freshness_check([("a", there, "t"), ("b", None, "t"), ("c", there, "t")]).collect()
    assert [r.state for r in got] == ["ok", "MISSING", "ok"]
