"""Service failures as intervals, weighed by demand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pedalgrid.constants import (
    BUCKET_MINUTES,
    BUCKETS_PER_HOUR,
    CONCENTRATION_TARGETS,
    OUTAGE_MIN_DEMAND,
    OUTAGE_MIN_MINUTES,
    OUTAGE_SWEEP,
)
from pedalgrid.operators.deltas import latest_station_info
from pedalgrid.operators.demand import with_demand

KINDS = {"starvation": "starved", "saturation": "saturated"}

#: Size of a quantile sketch.
SKETCH_K = 400


def outage_flags(grid: DataFrame, demand: DataFrame) -> DataFrame:
    """Starved: serving without e-bikes. Saturated: taking returns without a free dock."""
    return with_demand(grid, demand, "left").select(
        "bucket",
        "station_id",
        ((F.col("num_ebikes_available") == 0) & F.col("is_serving")).alias("starved"),
        ((F.col("num_docks_available") == 0) & (F.col("is_returning") == 1)).alias("saturated"),
        "ebike_demand_per_hour",
        "low_confidence",
    )


def outage_islands(flags: DataFrame) -> DataFrame:
    """Number unbroken runs of the same state: equal ``grp`` within a station and state.

    The number is how many rows in another state came before. It stays while a state lasts,
    and one pass in time order counts it for both kinds.
    """
    so_far = W.partitionBy("station_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = flags.withColumn("rn", F.count("*").over(so_far))
    for name, state in (("grp_starve", "starved"), ("grp_sat", "saturated")):
        on = F.count_if(F.col(state)).over(so_far)
        unknown = F.count_if(F.col(state).isNull()).over(so_far)
        alike = F.when(F.col(state), on).when(F.col(state).isNull(), unknown)
        seen = seen.withColumn(name, F.col("rn") - alike.otherwise(F.col("rn") - on - unknown))
    return seen


def outage_runs(islands: DataFrame) -> DataFrame:
    """One row per run: span, minutes, mean demand and the trips lost to starvation."""
    hits = F.array(
        F.when(
            F.col("starved"),
            F.struct(F.lit("starvation").alias("kind"), F.col("grp_starve").alias("grp")),
        ),
        F.when(
            F.col("saturated"),
            F.struct(F.lit("saturation").alias("kind"), F.col("grp_sat").alias("grp")),
        ),
    )
    return (
        islands.filter(F.col("starved") | F.col("saturated"))
        .withColumn("hit", F.explode(F.array_compact(hits)))
        .groupBy("hit.kind", "station_id", "hit.grp")
        .agg(
            F.min("bucket").alias("started_at"),
            F.max("bucket").alias("ended_at"),
            (F.count("*") * BUCKET_MINUTES).alias("minutes"),
            (F.sum("ebike_demand_per_hour") / BUCKETS_PER_HOUR).alias("lost_trips"),
            F.avg("ebike_demand_per_hour").alias("demand_per_hour"),
            F.bool_or("low_confidence").alias("low_confidence"),
        )
        .withColumn("lost_trips", F.when(F.col("kind") == "starvation", F.col("lost_trips")))
    )


def outage_events(
    runs: DataFrame,
    min_minutes: int = OUTAGE_MIN_MINUTES,
    min_demand: float = OUTAGE_MIN_DEMAND,
) -> DataFrame:
    wanted = F.coalesce("demand_per_hour", F.lit(0.0)) >= min_demand
    return runs.filter((F.col("minutes") >= min_minutes) & wanted)


def outage_stats(events: DataFrame) -> DataFrame:
    """Durations per kind. They are whole buckets, so exact percentiles need few counters."""
    return (
        events.groupBy("kind")
        .agg(
            F.count("*").alias("events"),
            F.count_distinct("station_id").alias("stations"),
            F.percentile("minutes", 0.5).alias("median_minutes"),
            F.percentile("minutes", 0.9).alias("p90_minutes"),
            F.max("minutes").alias("max_minutes"),
            F.sum("lost_trips").alias("lost_trips"),
        )
        .orderBy(F.desc("events"), "kind")
    )


def outage_sketches(events: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """One row per kind and month of start: counters, a quantile sketch of the minutes, a sketch of the stations.

    Rows of different months or parts merge (:func:`merged_outage_stats`), so a new month adds its own row and
    the history is not read again. A quantile's rank is off by some 2.7 / k (0.7 % by default) of all events.
    """
    return events.groupBy("kind", F.date_trunc("month", "started_at").alias("month")).agg(
        F.count("*").alias("events"),
        F.kll_sketch_agg_bigint(F.col("minutes").cast("long"), k).alias("minutes"),
        F.hll_sketch_agg("station_id").alias("stations"),
        F.max("minutes").alias("max_minutes"),
        F.sum("lost_trips").alias("lost_trips"),
    )


def store_outage_sketches(events: DataFrame, path: str) -> DataFrame:
    """Write the sketches of the months in ``events`` into the table at ``path``, in place of what it holds of them."""
    rows = outage_sketches(events).withColumn("month", F.date_format("month", "yyyy-MM"))
    rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    return events.sparkSession.read.schema(rows.schema).parquet(path)


def merged_outage_stats(sketches: DataFrame) -> DataFrame:
    """Like :func:`outage_stats` from sketches: count, maximum and sum are exact, the others estimates."""
    whole = sketches.groupBy("kind").agg(
        F.sum("events").alias("events"),
        F.hll_sketch_estimate(F.hll_union_agg("stations")).alias("stations"),
        F.kll_merge_agg_bigint("minutes").alias("minutes"),
        F.max("max_minutes").alias("max_minutes"),
        F.sum("lost_trips").alias("lost_trips"),
    )
    return whole.select(
        "kind",
        "events",
        "stations",
        F.kll_sketch_get_quantile_bigint("minutes", F.lit(0.5)).alias("median_minutes"),
        F.kll_sketch_get_quantile_bigint("minutes", F.lit(0.9)).alias("p90_minutes"),
        "max_minutes",
        "lost_trips",
    ).orderBy(F.desc("events"), "kind")


def outage_concentration(
    events: DataFrame, grid: DataFrame, targets=CONCENTRATION_TARGETS
) -> DataFrame:
    """How few stations, worst first, make up each share of all starved hours.

    Stations with equal hours share their running sum, so a histogram of station totals
    carries everything; it has at most one row per possible number of minutes.
    """
    per_station = (
        events.filter(F.col("kind") == "starvation")
        .groupBy("station_id")
        .agg(F.sum("minutes").alias("minutes"))
    )
    hist = per_station.groupBy("minutes").agg(F.count("*").alias("n"))
    worst_first = W.orderBy(F.desc("minutes")).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy()
    spent = F.col("minutes") * F.col("n")
    ranked = hist.select(
        (F.sum("n").over(worst_first) - F.col("n") + 1).alias("first_rank"),
        (F.sum(spent).over(worst_first) / F.sum(spent).over(whole)).alias("cum"),
    )
    one = ranked.agg(
        *(
            F.min(F.when(F.col("cum") >= t, F.col("first_rank"))).alias(f"t{i}")
            for i, t in enumerate(targets)
        )
    )
    stations = grid.select("station_id").distinct().agg(F.count("*").alias("n"))
    rows = F.array(
        *(
            F.struct(F.lit(t).alias("target"), F.col(f"t{i}").alias("stations"))
            for i, t in enumerate(targets)
        )
    )
    return (
        one.select(F.inline(rows))
        .filter(F.col("stations").isNotNull())
        .withColumn("network_share", F.col("stations") / stations.scalar())
    )


def worst_stations(events: DataFrame, info: DataFrame, limit: int = 8) -> DataFrame:
    names = latest_station_info(info.select("station_id", "fetched_on", "name"))
    per_station = (
        events.filter(F.col("kind") == "starvation")
        .groupBy("station_id")
        .agg(
            F.sum("minutes").alias("minutes"),
            F.count("*").alias("events"),
            F.sum("lost_trips").alias("lost_trips"),
        )
    )
    return (
        per_station.join(names.select("station_id", "name"), "station_id")
        .groupBy("name")
        .agg(
            (F.sum("minutes") / 60.0).alias("hours"),
            F.sum("events").alias("events"),
            F.sum("lost_trips").alias("lost_trips"),
        )
        .orderBy(F.desc("hours"), "name")
        .limit(limit)
    )


def outage_duration_sweep(
    runs: DataFrame, durations=OUTAGE_SWEEP, min_demand: float = OUTAGE_MIN_DEMAND
) -> DataFrame:
    """Starvation totals at several minimum durations, from one pass over the runs."""
    starved = outage_events(runs.filter(F.col("kind") == "starvation"), 0, min_demand)

    def kept(m: int, value):
        return F.when(F.col("minutes") >= m, value)

    one = starved.agg(
        *(
            stat.alias(f"{name}{m}")
            for m in durations
            for name, stat in (
                ("n", F.count(kept(m, F.lit(1)))),
                ("h", F.sum(kept(m, F.col("minutes"))) / 60.0),
                ("l", F.sum(kept(m, F.col("lost_trips")))),
            )
        )
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(m).alias("min_minutes"),
                F.col(f"n{m}").alias("events"),
                F.col(f"h{m}").alias("hours"),
                F.col(f"l{m}").alias("lost_trips"),
            )
            for m in durations
        )
    )
    return one.select(F.inline(rows))
