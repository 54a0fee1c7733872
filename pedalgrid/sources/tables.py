"""Table maintenance as DataFrame operations and plain writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from pedalgrid.constants import KEEP_DAYS
from pedalgrid.functions.picking import first_per, latest_per
from pedalgrid.session import cut_lineage, fresh_path, remove_path


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Drop and rebuild a stored table from a query that does not read it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_dimension(df: DataFrame, path: str) -> DataFrame:
    """Replace a small, slowly changing table wholesale."""
    return materialize(df, path)


def sized(rows: DataFrame, folder: str, *order: str) -> DataFrame:
    """Rows dealt for a write partitioned by ``folder``: files of about the advisory partition size of adaptive
    execution (spark.sql.adaptive.advisoryPartitionSizeInBytes), as many as a folder needs, one if it is small.

    Within a file rows follow ``order``, so a filter on it skips row groups.
    """
    known = [c for c in order if c in rows.columns]
    return rows.hint("rebalance", F.col(folder)).sortWithinPartitions(folder, *known)


def load_months(rows: DataFrame, path: str, time_col: str = "started_at") -> int:
    """Add the months of ``rows`` that the table at ``path`` does not hold yet, in one write.

    A month is one directory ``source_month=<month>`` that appears as a whole when the write commits,
    so a load that died can run again. Returns the number of months added.
    """
    spark = rows.sparkSession
    new = rows
    if _exists(spark, path):
        there = read_months(spark, path).select("source_month").distinct()
        new = rows.join(F.broadcast(there), "source_month", "left_anti")  # a row per month
    count = new.select("source_month").distinct().count()
    if count:
        (
            sized(new, "source_month", time_col)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("source_month")
            .parquet(path)
        )
    return count


def load_report(rows: DataFrame, path: str, time_col: str = "started_at") -> DataFrame:
    """Load the months of ``rows``; a row per month: how many rows the table holds of it, and whether this load brought
    them (else it was there and skipped)."""
    spark = rows.sparkSession
    asked = rows.select("source_month").distinct()
    known = read_months(spark, path).select("source_month").distinct() if _exists(spark, path) else asked.limit(0)
    known = cut_lineage(known.withColumn("loaded", F.lit(False)), "known-months")
    load_months(rows, path, time_col)
    held = read_months(spark, path).groupBy("source_month").agg(F.count("*").alias("rows"))
    found = asked.join(held, "source_month").join(known, "source_month", "left")
    return found.withColumn("loaded", F.coalesce("loaded", F.lit(True)))


def load_month_once(rows: DataFrame, path: str, month: str) -> int:
    """The same for the rows of one month; returns the months written (0 or 1)."""
    return load_months(rows.withColumn("source_month", F.lit(month)), path)


def read_months(spark: SparkSession, path: str) -> DataFrame:
    loaded = spark.read.option("recursiveFileLookup", False).parquet(path)
    return loaded.withColumn("source_month", F.col("source_month").cast("string"))


def mirror_incremental(
    source: DataFrame,
    path: str,
    time_col: str,
    keys: Sequence[str] | None = None,
    overlap_minutes: int = 0,
) -> DataFrame:
    """Append the source rows newer than everything mirrored so far; all of them at first.

    The high-water mark is a literal in the filter, so it is pushed into the source scan. It travels
    as a number: a local time would be ambiguous in the hour a clock repeats.
    Rows that arrive late with an older time are lost, unless an overlap window is asked
    for: then rows of that window are compared by ``keys`` and the unknown ones added. The mirror
    has a folder per UTC day; a row without time is not mirrored again.
    Returns the mirror as it is then.
    """
    spark = source.sparkSession
    fresh = source
    if _exists(spark, path):
        mirror = spark.read.parquet(path)
        newest_day = mirror.agg(F.max("day")).scalar()  # a folder per day: one of them is read
        newest = mirror.filter(F.col("day") == newest_day)
        high = newest.agg(F.max(F.unix_micros(time_col)).alias("t")).first()["t"]
        if high is not None:
            mark = F.timestamp_micros(F.lit(high))
            if overlap_minutes and keys:
                mark = mark - F.expr(f"interval {overlap_minutes} minutes")
                recent = mirror.filter((F.col("day") >= F.to_date(mark)) & (F.col(time_col) > mark))
                fresh = source.filter(F.col(time_col) > mark).join(recent.select(*keys), list(keys), "left_anti")
            else:
                fresh = source.filter(F.col(time_col) > mark)
    dated = sized(fresh.withColumn("day", F.to_date(time_col)), "day", time_col)
    dated.write.mode("append").partitionBy("day").parquet(path)
    whole = StructType([*source.schema.fields, StructField("day", DateType())])
    return spark.read.schema(whole).parquet(path).drop("day")


def insert_ignore(
    target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str
) -> DataFrame:
    """Target plus the first incoming row of every key it does not have."""
    firsts = first_per(incoming, keys, order).select(*incoming.columns)
    return target.unionByName(firsts.join(target.select(*keys), list(keys), "left_anti"))


def upsert_latest(
    target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str
) -> DataFrame:
    """Keyed state after the incoming rows: the newest row of every key.

    Of rows with an equal time an incoming one wins (it is a correction); among several of those the
    greatest by its other columns, so the result does not depend on where rows lie.
    """
    rest = [c for c in target.columns if c not in keys and c != order]
    side = lambda df, n: df.select(*target.columns, F.lit(n).alias("_side"))
    both = side(target, 0).unionByName(side(incoming, 1))
    return latest_per(both, keys, F.struct(order, "_side", *rest)).select(*target.columns)


def daily_snapshot_once(target: DataFrame, snapshot: DataFrame, day: str) -> DataFrame:
    """Rows to add for ``day``: the snapshot, or none if that day was taken already."""
    stamped = snapshot.withColumn("fetched_on", F.lit(day).cast("date"))
    taken = target.select("fetched_on").filter(F.col("fetched_on") == F.lit(day).cast("date"))
    return stamped.filter(~taken.exists()).select(*target.columns)


def update_from(
    target: DataFrame, updates: DataFrame, keys: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Target with ``cols`` taken from the matching update row, where there is one."""
    new = updates.select(
        *keys, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_new_{c}") for c in cols)
    )
    joined = target.join(new.hint("merge"), list(keys), "left")
    value = {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in cols}
    return joined.withColumns(value).select(*target.columns)


def _cutoff(log: DataFrame, time_col: str, keep_days: int):
    newest = log.agg(F.max(time_col).alias("t"))
    return newest.select(
        F.timestamp_micros(F.unix_micros("t") - keep_days * 86_400_000_000)
    ).scalar()


def retention_plan(log: DataFrame, time_col: str, keep_days: int = KEEP_DAYS) -> DataFrame:
    """What a retention run would delete."""
    marked = log.select(time_col).withColumn("cutoff", _cutoff(log, time_col, keep_days))
    return marked.agg(
        F.max("cutoff").alias("cutoff"),
        F.count("*").alias("total"),
        F.min(time_col).alias("oldest"),
        F.count_if(F.col(time_col) < F.col("cutoff")).alias("doomed"),
    )


def mirror_reconcile(
    source: DataFrame, mirror: DataFrame, time_col: str, keep_days: int = KEEP_DAYS
) -> DataFrame:
    """Per UTC day about to be deleted: rows on both sides, and whether the mirror has them."""
    cutoff = _cutoff(source, time_col, keep_days)

    def days(df: DataFrame, name: str) -> DataFrame:
        old = df.filter(F.col(time_col) < cutoff)
        return old.groupBy(F.to_date(time_col).alias("day")).agg(F.count("*").alias(name))

    both = days(source, "source_rows").join(days(mirror, "mirror_rows"), "day", "left")
    return both.withColumn("mirror_rows", F.coalesce("mirror_rows", F.lit(0))).withColumn(
        "ok", F.col("mirror_rows") >= F.col("source_rows")
    )


def retention_delete(
    source: DataFrame,
    mirror: DataFrame,
    time_col: str,
    keep_days: int = KEEP_DAYS,
    apply: bool = False,
) -> DataFrame:
    """What stays after the deletion. A dry run keeps all; one unmirrored day aborts."""
    if not apply:
        return source
    checked = mirror_reconcile(source, mirror, time_col, keep_days)
    if not checked.filter(~F.col("ok")).isEmpty():
        raise ValueError("some days are not fully mirrored; nothing was deleted")
    return source.filter(F.col(time_col) >= _cutoff(source, time_col, keep_days))


class NotMirrored(ValueError):
    """A retention run would lose rows that the mirror does not hold."""


def write_days(log: DataFrame, path: str, time_col: str) -> DataFrame:
    """Store a log with one directory per UTC day."""
    dated = log.withColumn("day", F.to_date(time_col))
    sized(dated, "day", time_col).write.partitionBy("day").parquet(path)
    return read_days(log.sparkSession, path)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def retention_run(
    spark: SparkSession, path: str, mirror: DataFrame, time_col: str, keep_days: int = KEEP_DAYS
) -> DataFrame:
    """Delete what is older than ``keep_days`` from a log stored by day; returns what is left.

    The guard comes first: one day that the mirror does not hold in full, and nothing is deleted. Days
    wholly before the cutoff go as directories, the cutoff's own day is written anew.
    """
    log = read_days(spark, path)
    if not mirror_reconcile(log, mirror, time_col, keep_days).filter(~F.col("ok")).isEmpty():
        raise NotMirrored("some days are not fully mirrored; nothing was deleted")
    newest = log.agg(F.max(F.unix_micros(time_col)).alias("t")).first()["t"]
    if newest is None:
        return log
    cutoff = F.timestamp_micros(F.lit(newest - keep_days * 86_400_000_000))
    whole_day = (F.date_add("day", 1).cast("timestamp") <= cutoff).alias("whole")
    days = log.select("day").distinct().filter(F.col("day") <= F.to_date(cutoff)).select("day", whole_day)
    for day, whole in sorted((str(r["day"]), r["whole"]) for r in days.collect()):  # directories of the deleted span
        target = f"{path}/day={day}"
        if whole:
            remove_path(spark, target)
        else:
            kept = log.filter((F.col("day") == day) & (F.col(time_col) >= cutoff)).drop("day")
            beside = fresh_path(spark, "cutoff-day")
            kept.write.parquet(beside)
            spark.read.schema(kept.schema).parquet(beside).write.mode("overwrite").parquet(target)
    return read_days(spark, path)
