"""Bucket-to-bucket changes of a station and what probably caused them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pedalgrid.constants import (
    FEED_ARTIFACT,
    IDLE,
    NO_OBSERVATION,
    RIDER_CHURN,
    VAN_DROPOFF,
    VAN_MIN_BIKES,
    VAN_PICKUP,
    VAN_PREFIX,
    VAN_SWEEP,
)
from pedalgrid.functions.picking import latest_per

MEASURES = {
    "bikes": "num_bikes_available",
    "ebikes": "num_ebikes_available",
    "classic": "classic_available",
    "docks": "num_docks_available",
    "disabled": "num_bikes_disabled",
}


def with_previous(grid: DataFrame) -> DataFrame:
    """Rows that have a state, each with the values of the station's row before."""
    w = W.partitionBy("station_id").orderBy("bucket")
    named = grid.filter(F.col("num_bikes_available").isNotNull()).select(
        "bucket", "station_id", "state_as_of", *(F.col(c).alias(n) for n, c in MEASURES.items())
    )
    return named.withColumns(
        {f"p_{c}": F.lag(c).over(w) for c in [*MEASURES, "state_as_of"]}
    )


def imbalance() -> Column:
    """A moved bike frees or takes a dock; this many units of a change did not."""
    return F.abs(F.col("d_bikes") + F.col("d_docks"))


def event_class(
    pickup_at: Column, dropoff_at: Column, artifact_at: int, unbalanced: Column | None = None
) -> Column:
    """Label of a delta row. The first rule that holds wins; an unknown rule does not hold."""
    moved = F.col("d_bikes")
    odd = imbalance() > 1 if unbalanced is None else unbalanced
    return (
        F.when(F.col("carried_forward"), NO_OBSERVATION)
        .when(odd & (F.abs(moved) >= artifact_at), FEED_ARTIFACT)
        .when(moved >= dropoff_at, VAN_DROPOFF)
        .when(moved <= -pickup_at, VAN_PICKUP)
        .when(moved != 0, RIDER_CHURN)
        .otherwise(IDLE)
    )


def station_deltas(grid: DataFrame, van_min: int = VAN_MIN_BIKES) -> DataFrame:
    """Five differences per row, whether the state was only carried forward, and a label."""
    seq = with_previous(grid).filter(F.col("p_bikes").isNotNull())
    diffs = seq.select(
        "bucket",
        "station_id",
        *((F.col(c) - F.col(f"p_{c}")).alias(f"d_{c}") for c in MEASURES),
        "bikes",
        "docks",
        (F.col("state_as_of") == F.col("p_state_as_of")).alias("carried_forward"),
    )
    return diffs.withColumn("event_class", event_class(F.lit(van_min), F.lit(van_min), van_min))


def is_van() -> Column:
    return F.col("event_class").startswith(VAN_PREFIX)


def event_class_rollup(deltas: DataFrame) -> DataFrame:
    classes = deltas.groupBy("event_class").agg(
        F.count("*").alias("cells"), F.sum(F.abs("d_bikes")).cast("bigint").alias("bikes_moved")
    )
    everything = W.partitionBy()  # six rows at most
    return classes.withColumn(
        "share", F.col("cells") / F.sum("cells").over(everything)
    ).orderBy(F.desc("cells"), "event_class")


def van_totals(deltas: DataFrame) -> DataFrame:
    return deltas.filter(is_van()).agg(
        F.count("*").alias("events"),
        F.count_distinct("station_id").alias("stations"),
        F.sum(F.abs("d_bikes")).cast("bigint").alias("bikes_moved"),
    )


def latest_station_info(info: DataFrame, required: str | None = None) -> DataFrame:
    """The newest dimension row per station, of those where ``required`` is known."""
    known = info.filter(F.col(required).isNotNull()) if required else info
    return latest_per(known, ["station_id"], "fetched_on")


def van_listing(deltas: DataFrame, info: DataFrame, limit: int = 15) -> DataFrame:
    """The first van events in time with the station's newest name."""
    names = latest_station_info(info.select("station_id", "fetched_on", "name"))
    first = deltas.filter(is_van()).select("bucket", "station_id", "d_bikes")
    return (
        first.join(names.select("station_id", "name"), "station_id")
        .orderBy("bucket", "station_id")
        .limit(limit)
        .select(
            "bucket",
            F.substring("name", 1, 34).alias("name"),
            "station_id",
            "d_bikes",
            F.when(F.col("d_bikes") > 0, "dropoff").otherwise("pickup").alias("kind"),
        )
    )


def van_threshold_sweep(deltas: DataFrame, thresholds=VAN_SWEEP) -> DataFrame:
    """Events that would count as van moves at each threshold, from one scan."""
    balanced = ~F.col("carried_forward") & (imbalance() <= 1)
    one = deltas.agg(
        *(F.count_if(balanced & (F.abs("d_bikes") >= k)).alias(f"k{k}") for k in thresholds)
    )
    rows = F.array(
        *(F.struct(F.lit(k).alias("threshold"), F.col(f"k{k}").alias("events")) for k in thresholds)
    )
    return one.select(F.inline(rows))


def van_gap_latency(deltas: DataFrame) -> DataFrame:
    """Minutes between consecutive van events of the whole fleet: min, median, p90, max.

    Equal instants give no gap, so the distinct buckets are enough; and the gaps are
    multiples of the bucket width, so a histogram of them stays small.
    """
    buckets = deltas.filter(is_van()).select("bucket").distinct()
    in_time = W.orderBy("bucket")  # at most one row per bucket of the covered span
    gap = (F.unix_micros("bucket") - F.unix_micros(F.lag("bucket").over(in_time))) / 60_000_000
    hist = (
        buckets.select(gap.cast("int").alias("gap"))
        .filter(F.col("gap").isNotNull())
        .groupBy("gap")
        .agg(F.count("*").alias("n"))
    )
    upto = W.orderBy("gap").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy()
    ranked = hist.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(whole)})

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("upto") > position, F.col("gap")))

    total = F.col("total")
    return ranked.agg(
        F.max("total").alias("gaps"),
        F.min("gap").alias("min_gap"),
        at(F.floor(total / 2)).alias("median_gap"),
        at(F.floor(total * F.lit(0.9))).alias("p90_gap"),
        F.max("gap").alias("max_gap"),
    ).filter(F.col("gaps").isNotNull())
