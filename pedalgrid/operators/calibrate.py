"""Van labels by surprise: a fixed point between flow rates and labels.

A label depends on a row only through its demand cell, its size and two flags. So the
rows are counted once per such combination and the rounds run on that histogram, which
does not grow with the length of the history.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pedalgrid.constants import (
    ACTIVITY_BANDS,
    BUCKET_MINUTES,
    BUCKETS_PER_HOUR,
    CALIBRATION_ROUNDS,
    RIDER_CHURN,
    SURPRISE_ALPHA,
    SURPRISE_FLOOR,
    VAN_MIN_BIKES,
    VAN_PREFIX,
)
from pedalgrid.functions.poisson import surprise_threshold
from pedalgrid.functions.timeutil import with_local_clock
from pedalgrid.operators.deltas import event_class, imbalance
from pedalgrid.session import cut_lineage

CELL = ["station_id", "daytype", "hour"]


def move_histogram(grid: DataFrame, deltas: DataFrame) -> DataFrame:
    """Rows per (cell, label, flags, change), with how many of them had stock or room before."""
    w = W.partitionBy("station_id").orderBy("bucket")
    before = grid.filter(F.col("num_bikes_available").isNotNull()).select(
        "station_id",
        "bucket",
        ((F.lag("num_bikes_available").over(w) > 0) & F.lag("is_serving").over(w)).alias("out_ok"),
        (F.lag("num_docks_available").over(w) > 0).alias("in_ok"),
    )
    moves = deltas.select(
        "station_id",
        "bucket",
        "d_bikes",
        "event_class",
        "carried_forward",
        (imbalance() > 1).alias("unbalanced"),
    )
    rated = F.col("out_ok").isNotNull()
    both = before.join(moves.hint("merge"), ["station_id", "bucket"], "left")
    return (
        with_local_clock(both)
        .groupBy(*CELL, "event_class", "carried_forward", "unbalanced", "d_bikes")
        .agg(
            F.count("*").alias("cells"),
            F.count_if(rated).alias("rated"),
            F.count_if(F.col("out_ok")).alias("out_exposed"),
            F.count_if(rated & F.col("in_ok")).alias("in_exposed"),
        )
    )


def flow_rates(histogram: DataFrame) -> DataFrame:
    """Departures and arrivals per hour of each cell, over the time they were possible."""
    churn = F.col("event_class") == RIDER_CHURN
    moved = F.col("d_bikes")

    def per_hour(flow: Column, exposed: str) -> Column:
        bikes = F.sum(F.when(churn & (flow > 0), flow * F.col("rated")).otherwise(0))
        return F.try_divide(bikes, F.sum(exposed)) * BUCKETS_PER_HOUR

    return (
        histogram.filter(F.col("rated") > 0)
        .groupBy(*CELL)
        .agg(
            per_hour(-moved, "out_exposed").alias("dep_per_hour"),
            per_hour(moved, "in_exposed").alias("arr_per_hour"),
        )
    )


def cell_thresholds(rates: DataFrame, alpha: float = SURPRISE_ALPHA) -> DataFrame:
    """How many bikes at once are a surprise in each cell, leaving and arriving."""

    def limit(rate: str) -> Column:
        expected = F.coalesce(F.col(rate), F.lit(0.0)) * BUCKET_MINUTES / 60
        return surprise_threshold(expected, alpha)

    return rates.select(
        *CELL, limit("dep_per_hour").alias("out_k"), limit("arr_per_hour").alias("in_k")
    )


def _relabelled(rows: DataFrame, thresholds: DataFrame, unbalanced: Column) -> DataFrame:
    known = thresholds.select(*CELL, "out_k", "in_k")
    label = event_class(
        F.coalesce("out_k", F.lit(VAN_MIN_BIKES)),
        F.coalesce("in_k", F.lit(VAN_MIN_BIKES)),
        SURPRISE_FLOOR,
        unbalanced,
    )
    return rows.join(known, CELL, "left").withColumn("new_class", label).drop("out_k", "in_k")


def relabel_events(deltas: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Delta rows with ``new_class``, judged by their cell's thresholds (5 where unknown)."""
    return _relabelled(with_local_clock(deltas), thresholds, imbalance() > 1).drop("daytype", "hour")


def label_churn(relabelled: DataFrame) -> DataFrame:
    """How many rows changed their label, and how many are van moves now."""
    return relabelled.agg(
        F.count_if(F.col("event_class") != F.col("new_class")).alias("changed"),
        F.count_if(is_van_label("new_class")).alias("vans"),
    )


def is_van_label(col: str) -> Column:
    return F.col(col).startswith(VAN_PREFIX)


def threshold_median(thresholds: DataFrame) -> DataFrame:
    return thresholds.agg(F.median("out_k").alias("median_out_k"))


def threshold_by_activity(
    rates: DataFrame, thresholds: DataFrame, bands=ACTIVITY_BANDS
) -> DataFrame:
    """Range of the departure threshold over cells grouped by how busy they are."""
    rate = F.coalesce("dep_per_hour", F.lit(0.0))
    one = (
        thresholds.join(rates.select(*CELL, "dep_per_hour"), CELL)
        .withColumn("rate", rate)
        .agg(
            *(
                stat(F.when((F.col("rate") > lo) & (F.col("rate") <= hi), F.col("out_k"))).alias(
                    f"{name}{i}"
                )
                for i, (_, lo, hi) in enumerate(bands)
                for name, stat in (("n", F.count), ("lo", F.min), ("hi", F.max))
            )
        )
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(label).alias("band"),
                F.col(f"n{i}").alias("cells"),
                F.col(f"lo{i}").alias("min_k"),
                F.col(f"hi{i}").alias("max_k"),
            )
            for i, (label, _, _) in enumerate(bands)
        )
    )
    return one.select(F.inline(rows))


@dataclass
class Calibration:
    deltas: DataFrame  # with the final event_class
    rates: DataFrame
    thresholds: DataFrame
    rounds: DataFrame  # round, vans, changed, median_out_k
    converged: bool


def calibrate_vans(
    grid: DataFrame,
    deltas: DataFrame,
    max_rounds: int = CALIBRATION_ROUNDS,
    alpha: float = SURPRISE_ALPHA,
    histogram: DataFrame | None = None,
) -> Calibration:
    """Alternate rates and labels until no label changes or the number of vans repeats.

    Pass the stored ``histogram`` of the two tables if there is one.
    """
    if histogram is None:
        histogram = cut_lineage(move_histogram(grid, deltas), "moves")
    report, vans_before, converged = [], None, False
    for turn in range(1, max_rounds + 1):
        rates = flow_rates(histogram)
        thresholds = cut_lineage(cell_thresholds(rates, alpha), "thresholds")
        moved = histogram.filter(F.col("d_bikes").isNotNull())
        judged = cut_lineage(_relabelled(moved, thresholds, F.col("unbalanced")), "judged")
        seen = judged.agg(
            F.sum(F.when(F.col("event_class") != F.col("new_class"), F.col("cells"))).alias("c"),
            F.sum(F.when(is_van_label("new_class"), F.col("cells"))).alias("v"),
        ).first()
        changed, vans = seen["c"] or 0, seen["v"] or 0
        median = threshold_median(thresholds).first()["median_out_k"]
        report.append((turn, vans, changed, median))
        unmoved = histogram.filter(F.col("d_bikes").isNull())
        histogram = judged.drop("event_class").withColumnRenamed("new_class", "event_class")
        histogram = histogram.unionByName(unmoved)
        if changed == 0 or vans == vans_before:
            converged = True
            break
        vans_before = vans
    final = relabel_events(deltas, thresholds).drop("event_class")
    spark = deltas.sparkSession
    return Calibration(
        deltas=final.withColumnRenamed("new_class", "event_class").select(*deltas.columns),
        rates=rates,
        thresholds=thresholds,
        rounds=spark.createDataFrame(
            report, "round int, vans bigint, changed bigint, median_out_k double"
        ),
        converged=converged,
    )
