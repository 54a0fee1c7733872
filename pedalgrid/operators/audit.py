"""Is the collection complete enough to analyse?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedalgrid.constants import COVERAGE_GATE_PCT, GATE_DAYS, SLOT_SECONDS
from pedalgrid.functions.ordered import sliced_lag
from pedalgrid.functions.timeutil import seconds_between


def _ok():
    return F.col("status") == "ok"


def since_filter(polls: DataFrame, start: str | None = None, days: float | None = None) -> DataFrame:
    """Polls from a fixed instant, or from ``days`` before now."""
    if days is not None:
        return polls.filter(
            F.col("polled_at")
            >= F.timestamp_micros(F.unix_micros(F.current_timestamp()) - int(days * 86_400_000_000))
        )
    return polls.filter(F.col("polled_at") >= F.lit(start).cast("timestamp")) if start else polls


def bucket_coverage_pct(polls: DataFrame, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Share of time slots with a good poll, over the span of all polls."""
    slot = F.floor(F.unix_micros("polled_at") / (slot_seconds * 1_000_000))
    span = seconds_between(F.min("first"), F.max("last"))
    by_slot = polls.groupBy(slot.alias("slot")).agg(
        F.min("polled_at").alias("first"),
        F.max("polled_at").alias("last"),
        F.bool_or(_ok()).alias("seen"),
    )
    totals = by_slot.agg(F.count_if("seen").alias("covered"), span.alias("window_seconds"))
    expected = F.floor(F.col("window_seconds") / slot_seconds) + 1
    pct = F.least(F.lit(100.0), F.try_divide(F.col("covered"), F.col("expected")) * 100)
    return totals.withColumn("expected", expected).withColumn("coverage_pct", pct)


def longest_gap(polls: DataFrame) -> DataFrame:
    """The longest time between good polls, and when it began; the earliest of equals."""
    good = polls.filter(_ok()).select("polled_at")
    steps = sliced_lag(good, [], "polled_at", ["polled_at"])
    start = F.col("prev.polled_at")
    gap = seconds_between(start, F.col("polled_at"))
    return (
        steps.select(gap.alias("gap_seconds"), start.alias("started_at"))
        .filter(F.col("gap_seconds") > 0)
        .agg(
            F.max(
                F.struct("gap_seconds", (-F.unix_micros("started_at")).alias("earliest"))
            ).alias("m")
        )
        .filter(F.col("m").isNotNull())
        .select("m.gap_seconds", F.timestamp_micros(-F.col("m.earliest")).alias("started_at"))
    )


def poll_errors(polls: DataFrame, last: int = 5) -> DataFrame:
    """The most recent failures, next to how many polls went well and badly."""
    counts = polls.agg(F.count_if(_ok()).alias("ok"), F.count_if(~_ok()).alias("bad"))
    return (
        polls.filter(~_ok())
        .orderBy(F.desc("polled_at"))
        .limit(last)
        .select("polled_at", "error")
        .withColumns(
            {"polls_ok": counts.select("ok").scalar(), "polls_error": counts.select("bad").scalar()}
        )
    )


def coverage_gate(
    coverage: DataFrame, gate_pct: float = COVERAGE_GATE_PCT, gate_days: int = GATE_DAYS
) -> DataFrame:
    days = F.col("window_seconds") / 86400.0
    verdict = (
        F.when(F.col("days") < gate_days, "not yet")
        .when(F.col("coverage_pct") >= gate_pct, "passed")
        .otherwise("failed")
    )
    return coverage.withColumn("days", days).select("days", "coverage_pct", verdict.alias("gate"))


def collection_summary(polls: DataFrame, status: DataFrame) -> DataFrame:
    log = status.agg(
        F.count("*").alias("rows"), F.count_distinct("station_id").alias("stations")
    )
    return polls.agg(
        F.count_if(_ok()).alias("polls_ok"),
        F.count_if(~_ok()).alias("polls_error"),
        F.min("polled_at").alias("first_poll"),
        F.max("polled_at").alias("last_poll"),
    ).withColumns(
        {
            "status_rows": log.select("rows").scalar(),
            "stations": log.select("stations").scalar(),
        }
    )
