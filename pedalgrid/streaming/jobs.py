"""Streaming jobs: file source in, Parquet out, progress in the shared folder."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedalgrid.constants import BUCKET_MINUTES
from pedalgrid.functions.ordered import slice_bounds, slice_of
from pedalgrid.session import fresh_path, remove_path, shuffle_width
from pedalgrid.streaming.keyed_table import KeyedTable


def feed_in_order(rows: DataFrame, time_col: str, path: str, batch_rows: int) -> None:
    """Write ``rows`` as files whose order of arrival is their order in time.

    The rows are written once, partitioned into slices of about ``batch_rows``; each slice is one
    directory there and is appended to ``path`` as one file. With ``maxFilesPerTrigger`` 1 a
    micro-batch is a slice, however many there are.
    """
    spark = rows.sparkSession
    us = F.unix_micros(time_col)
    steps = max(3, math.ceil(rows.count() / batch_rows))
    bounds = slice_bounds(rows, us, steps, limit=None)
    cut = fresh_path(spark, "feed-slices")
    sliced = rows.withColumn("_slice", slice_of(us, bounds))
    dealt = sliced.repartition(shuffle_width(spark), "_slice", F.pmod(us, F.lit(16)))
    dealt.write.partitionBy("_slice").parquet(cut)
    stored = spark.read.schema(sliced.schema).parquet(cut)
    for i in range(len(bounds) + 1):
        stored.filter(F.col("_slice") == i).drop("_slice").coalesce(1).write.mode("append").parquet(path)
    remove_path(spark, cut)


def run_available(stream: DataFrame, label: str, out: str | None = None, progress: str | None = None):
    """Process what is there, append it to Parquet, stop; returns the sink as a table.

    Pass the same ``out`` and ``progress`` again to go on where the last run ended.
    """
    spark = stream.sparkSession
    out = out or fresh_path(spark, label)
    progress = progress or fresh_path(spark, f"{label}-progress")
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", progress)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_upserting(stream: DataFrame, label: str, keys: Sequence[str], order: str, mode: str = "update"):
    """Process what is there into a :class:`KeyedTable`, stop; returns the newest row of every key.

    In update mode every change of an aggregate arrives, also of windows the watermark has not
    passed when the input ends: nothing is held back.
    """
    spark = stream.sparkSession
    table = KeyedTable(spark, fresh_path(spark, label), stream.schema, keys, order)
    query = (
        stream.writeStream.foreachBatch(table.apply)
        .option("checkpointLocation", fresh_path(spark, f"{label}-progress"))
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return table.read()


def tumbling_counts(
    rows: DataFrame, time_col: str, lateness: str = "10 minutes", minutes: int = BUCKET_MINUTES
) -> DataFrame:
    """Observations per bucket.

    In append mode a bucket is emitted once the watermark passes its end, the last ones never; use
    update mode and an upsert (:func:`run_upserting`) where the input can end.
    """
    window = F.window(time_col, f"{minutes} minutes")
    return (
        rows.withWatermark(time_col, lateness)
        .groupBy(window.alias("w"))
        .agg(F.count("*").alias("observations"))
        .select(F.col("w.start").alias("bucket"), "observations")
    )


def first_only(
    rows: DataFrame, keys: Sequence[str], time_col: str, lateness: str = "1 hour"
) -> DataFrame:
    """Insert-ignore on a stream: later copies of a key within the watermark are dropped."""
    return rows.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark(list(keys))
