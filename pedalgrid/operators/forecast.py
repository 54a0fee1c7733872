"""Will a station be out of e-bikes some minutes from now, and how well can one tell?"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pedalgrid.constants import (
    BOOSTING_ROUNDS,
    BUCKET_MINUTES,
    HORIZONS_MINUTES,
    MIN_POSITIVES,
    TRAIN_SHARE,
)
from pedalgrid.functions.boosting import DEPTH, RANGES, fit_trees, leaf_tables, merged, score_leaves, spark_trees
from pedalgrid.functions.ordered import slice_of
from pedalgrid.functions.scores import average_precision
from pedalgrid.operators.demand import with_demand
from pedalgrid.session import cut_lineage, forget, fresh_path, shared_dir

FEATURES = ["ebikes", "bikes", "docks", "hour", "weekend", "demand_bin", "flow_30m", "flow_60m"]
#: The trees tell apart as many ranges of a feature; of the demand they are made before, on all training rows.
BINS = RANGES
#: Distinct training rows of a horizon that one task holds, some 120 bytes each; more are left to Spark's trainer.
FIT_ROWS = 1 << 21
TREES = "tree int, feature array<long>, upto array<long>, value array<double>"


def forecast_rows(grid: DataFrame, demand: DataFrame, horizons=HORIZONS_MINUTES) -> DataFrame:
    """One row per (bucket, station): past flows, and ``later`` with the outcome per horizon.

    Steps back and ahead count serving rows of confident cells, not minutes. All
    horizons share one window. Rows without an hour of past are left out.
    """
    w = W.partitionBy("station_id").orderBy("bucket")
    ebikes = F.col("num_ebikes_available")
    usable = with_demand(grid, demand).filter(F.col("is_serving") & ~F.col("low_confidence"))

    def flow(steps: int):
        return ebikes - F.lag(ebikes, steps).over(w)

    def outcome(minutes: int):
        steps = minutes // BUCKET_MINUTES
        stock = F.lead(ebikes, steps).over(w)
        starved = (stock == 0) & F.lead("is_serving", steps).over(w)
        return F.when(
            stock.isNotNull(),
            F.struct(F.lit(minutes).alias("horizon"), F.when(starved, 1).otherwise(0).alias("starved")),
        )

    rows = usable.select(
        "bucket",
        "station_id",
        ebikes.alias("ebikes"),
        F.col("num_bikes_available").alias("bikes"),
        F.col("num_docks_available").alias("docks"),
        "hour",
        (F.col("daytype") == "weekend").cast("int").alias("weekend"),
        F.col("ebike_demand_per_hour").alias("demand"),
        flow(6).alias("flow_30m"),
        flow(12).alias("flow_60m"),
        F.array(*(outcome(h) for h in horizons)).alias("later"),
    )
    return rows.filter(F.col("flow_60m").isNotNull()).withColumn(
        "flow_30m", F.coalesce("flow_30m", F.lit(0).cast("smallint"))
    )


def by_horizon(rows: DataFrame) -> DataFrame:
    """Fan out to one row per (horizon, bucket, station); a horizon without outcome has none."""
    others = [c for c in rows.columns if c != "later"]
    fanned = rows.select(*others, F.explode("later").alias("later"))
    return fanned.filter(F.col("later").isNotNull()).select(
        "later.horizon", *others, F.col("later.starved").alias("starved_future")
    )


def forecast_features(
    grid: DataFrame, demand: DataFrame, horizons=HORIZONS_MINUTES
) -> DataFrame:
    """One row per (horizon, bucket, station) with past flows and the later outcome."""
    return by_horizon(forecast_rows(grid, demand, horizons))


def split_point(grid: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    """The instant that splits the grid's span into an earlier and a later part."""
    span = grid.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    lo, hi = F.unix_micros("lo"), F.unix_micros("hi")
    return span.select(
        F.timestamp_micros(lo + F.round((hi - lo) * F.lit(share)).cast("bigint")).alias("cut")
    )


def chrono_split(rows: DataFrame, grid: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    """Mark rows at or after the split point as ``is_test``; nothing is shuffled in time."""
    return rows.withColumn("is_test", F.col("bucket") >= split_point(grid, share).scalar())


def runway_score(rows: DataFrame) -> DataFrame:
    """Less stock per demand, higher score."""
    hours = F.col("ebikes") / F.greatest("demand", F.lit(1e-6))
    return rows.withColumn("b0", -hours)


def forecast_skill(
    scored: DataFrame, score: str = "b0", min_positives: int = MIN_POSITIVES
) -> DataFrame:
    """Per horizon on the test rows: size, base rate, average precision and lift."""
    ap = average_precision(scored.filter("is_test"), ["horizon"], score, "starved_future")
    return (
        ap.filter(F.col("positives") >= min_positives)
        .select(
            "horizon",
            F.col("rows").alias("test_rows"),
            (F.col("positives") / F.col("rows")).alias("base_rate"),
            F.col("ap").alias("average_precision"),
        )
        .withColumn("lift", F.col("average_precision") / F.col("base_rate"))
    )


def onset_skill(
    scored: DataFrame, score: str = "b0", min_positives: int = MIN_POSITIVES
) -> DataFrame:
    """The same where the station still has e-bikes: an empty one staying empty is no forecast.

    A horizon counts if all its test rows hold enough positives.
    """
    hits = scored.filter("is_test").groupBy("horizon").agg(F.sum("starved_future").alias("hits"))
    counted = hits.filter(F.col("hits") >= min_positives).select("horizon")
    onset = forecast_skill(scored.filter(F.col("ebikes") > 0), score, 1)
    return onset.join(F.broadcast(counted), "horizon", "left_semi")  # a row per horizon


def demand_bins(rows: DataFrame, bins: int = BINS) -> Bucketizer:
    """Ranges of the demand of about equal numbers of rows: the only feature that is not a count."""
    shares = [i / bins for i in range(1, bins)]
    cuts = rows.agg(F.percentile_approx("demand", shares, 100 * bins).alias("q")).first()["q"] or []
    return Bucketizer(
        splits=[float("-inf"), *sorted({float(c) for c in cuts}), float("inf")], inputCol="demand", outputCol="demand_bin"
    )


def weighted_rows(rows: DataFrame, bins: Bucketizer) -> DataFrame:
    """Rows that trees cannot tell apart as one, with their number as ``weight``.

    There are as many as stocks, hours and demand ranges meet, however long the history and large the fleet.
    """
    return bins.transform(rows).groupBy("horizon", "starved_future", *FEATURES).agg(F.count("*").cast("double").alias("weight"))


def feature_cuts(train: DataFrame, bins: int = BINS) -> dict[str, list[float]]:
    """Where the ranges of each feature end: between any two values, or where about equal numbers of rows lie if
    there are more than ``bins``. The driver gets the distinct values of counts."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in FEATURES)))
    counted = train.select(each.alias("e"), "weight").filter("e.value IS NOT NULL").groupBy("e.feature", "e.value")
    found = counted.agg(F.sum("weight").alias("n")).toPandas().sort_values("value")
    cuts = {}
    for f in FEATURES:
        own = found[found["feature"] == f]
        values, upto = own["value"].to_numpy(), own["n"].cumsum().to_numpy()
        last = np.arange(len(values) - 1)
        if len(values) > bins:
            last = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, bins) / bins))
            last = last[last < len(values) - 1]
        cuts[f] = ((values[last] + values[last + 1]) / 2).tolist() if len(values) else []
    return cuts


def _ranges(columns: Mapping[str, pd.Series], cuts: Mapping[str, Sequence[float]]) -> np.ndarray:
    """The range of each feature, a row per row; what is missing counts as greatest."""
    return np.stack([np.searchsorted(cuts[f], columns[f].to_numpy(float)) for f in FEATURES], axis=1).astype(np.uint8)


def _tree_rows(trees: tuple[np.ndarray, ...]) -> pd.DataFrame:
    return pd.DataFrame({"tree": range(len(trees[0]))} | dict(zip(("feature", "upto", "value"), (t.tolist() for t in trees), strict=True)))


def _fit_run(cuts: dict[str, list[float]], rounds: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(np.zeros((0, len(FEATURES)), np.uint8), np.zeros(0, np.uint8), np.zeros(0))]
        parts += [(_ranges(b, cuts), b["starved_future"].to_numpy(np.uint8), b["weight"].to_numpy()) for b in batches]
        rows = merged(*(np.concatenate(p) for p in zip(*parts, strict=True)))
        yield _tree_rows(fit_trees(*rows, [len(cuts[f]) + 1 for f in FEATURES], rounds))

    return run


def _fit_spread(train: DataFrame, cuts: dict[str, list[float]], rounds: int, seed: int) -> DataFrame:
    """The same trees by Spark's trainer, whose rows are spread over tasks: some six jobs a round."""
    ranges = [slice_of(F.col(f).cast("double"), cuts[f]).cast("double").alias(f) for f in FEATURES]
    counted = train.select("starved_future", "weight", *ranges).groupBy("starved_future", *FEATURES).agg(F.sum("weight").alias("weight"))
    trees = GBTClassifier(
        labelCol="starved_future", weightCol="weight", maxIter=rounds, maxDepth=DEPTH, seed=seed, maxBins=BINS, checkpointInterval=10
    )
    model = trees.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(counted))
    return train.sparkSession.createDataFrame(_tree_rows(spark_trees(model)), TREES)


def fit_models(
    rows: DataFrame,
    folder: str,
    rounds: int = BOOSTING_ROUNDS,
    min_positives: int = MIN_POSITIVES,
    seed: int = 0,
) -> list[int]:
    """Fit boosted trees on the training rows of each horizon that has enough positives, side by side.

    The trees see every training row, equal ones as one row with a weight. A task holds the rows of a horizon as
    ranges and fits all rounds; more than ``FIT_ROWS`` are spread. Each model is stored in ``folder``, with the
    ranges of its features; returns the horizons.
    """
    spark = rows.sparkSession
    shared_dir(spark)  # Spark's trainer cuts its lineage there
    tested = rows.filter("is_test").groupBy("horizon").agg(F.sum("starved_future").alias("hits"))
    horizons = sorted(r.horizon for r in tested.filter(F.col("hits") >= min_positives).collect())
    if not horizons:
        raise ValueError("no horizon has enough positives in the test period")
    past = rows.filter(~F.col("is_test"))
    bins = demand_bins(past)
    train = cut_lineage(weighted_rows(past, bins), "train")
    held = {r.horizon: r["count"] for r in train.groupBy("horizon").count().collect()}
    cuts = feature_cuts(train)
    stored = cuts | {"demand": bins.getSplits()[1:-1]}
    spark.createDataFrame(list(stored.items()), "feature string, cuts array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/cuts")

    def fit(horizon: int) -> None:
        own = train.filter(F.col("horizon") == horizon).select("starved_future", "weight", *FEATURES)
        if held.get(horizon, 0) > FIT_ROWS:
            trees = _fit_spread(own, cuts, rounds, seed)
        else:
            trees = own.coalesce(1).mapInPandas(_fit_run(cuts, rounds), TREES)
        trees.write.mode("overwrite").parquet(f"{folder}/horizon={horizon}")

    with ThreadPool(len(horizons)) as pool:
        pool.map(fit, horizons)
    forget(train)
    return horizons


def score_models(rows: DataFrame, folder: str, horizons: Sequence[int]) -> DataFrame:
    """The test rows of the horizons with ``m1``, by the models stored in ``folder``, in one pass."""
    keep = ["horizon", "bucket", "station_id", "ebikes", "demand", "starved_future", "is_test"]
    spark = rows.sparkSession
    cuts = {r.feature: r.cuts for r in spark.read.parquet(f"{folder}/cuts").collect()}
    models = {}
    for horizon in horizons:
        trees = spark.read.schema(TREES).parquet(f"{folder}/horizon={horizon}").orderBy("tree").toPandas()
        feature, upto, value = (np.stack(trees[c]) for c in ("feature", "upto", "value"))
        models[horizon] = leaf_tables(feature, upto), value
    raw = [f if f != "demand_bin" else "demand" for f in FEATURES]

    @F.pandas_udf("double")
    def chance(horizon: pd.Series, *values: pd.Series) -> pd.Series:
        columns = dict(zip(FEATURES, values, strict=True))
        columns["demand_bin"] = pd.Series(np.searchsorted(cuts["demand"], columns["demand_bin"], side="right"))
        ranges, asked = _ranges(columns, cuts), horizon.to_numpy()
        out = np.zeros(len(asked))
        for h in np.unique(asked).tolist():
            own = asked == h
            out[own] = score_leaves(ranges[own], *models[h])
        return pd.Series(out)

    asked = rows.filter(F.col("is_test") & F.col("horizon").isin(list(horizons)))
    return asked.select(*keep, chance("horizon", *raw).alias("m1"))


def boosted_models(rows: DataFrame, rounds: int = BOOSTING_ROUNDS, min_positives: int = MIN_POSITIVES) -> DataFrame:
    """Fit and score in one."""
    folder = fresh_path(rows.sparkSession, "models")
    return score_models(rows, folder, fit_models(rows, folder, rounds, min_positives))


def model_report(scored: DataFrame) -> DataFrame:
    """Per horizon: what chance, demand alone (b0) and the trees (m1) score; the same where there still are e-bikes."""
    rows = runway_score(scored)
    whole = forecast_skill(rows, "m1").withColumnsRenamed({"average_precision": "ap_m1", "lift": "lift_m1"})
    simple = forecast_skill(rows, "b0").select("horizon", F.col("average_precision").alias("ap_b0"))
    onset = onset_skill(rows, "m1").select(
        "horizon",
        F.col("test_rows").alias("onset_rows"),
        F.col("base_rate").alias("onset_base_rate"),
        F.col("average_precision").alias("onset_ap_m1"),
        F.col("lift").alias("onset_lift_m1"),
    )
    return whole.join(simple, "horizon").join(onset, "horizon", "left")
