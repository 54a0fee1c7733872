"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partition column of tables stored by month.
MONTH = "_month"

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_own_dirs: dict[str, str] = {}
_made_paths: dict[str, list[str]] = {}
_made_tables: dict[str, list[str]] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators rely on.

    Stored instants are UTC, so the session clock must be too. The stored grid is bucketed
    by station and sorted: a join on (station, bucket) or (station, daytype, hour) may reuse
    that partitioning, and a window in time order need not sort again. A task reads a whole bucket also where no
    join needs it: what is stored from it then has one sorted file per bucket too. Streams with several state
    variables and timers per key need the state store in RocksDB. Instants are stored as 64-bit numbers, which
    are written and read faster than the default format of 96 bits and have statistics that filters on time use.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; in local mode alone, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="pedalgrid-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has written to yet."""
    path = f"{shared_dir(spark).rstrip('/')}/pedalgrid/{label}-{uuid.uuid4().hex}"
    _made_paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clean_up(spark: SparkSession) -> int:
    """Drop the tables and folders this session has made for intermediate results.

    DataFrames built on them cannot be read afterwards. Returns how many were removed.
    """
    app = spark.sparkContext.applicationId
    tables, paths = _made_tables.pop(app, []), _made_paths.pop(app, [])
    for table in tables:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    for path in paths:
        remove_path(spark, path)
    return len(tables) + len(paths)


def cut_lineage(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The copy survives lost executors, and later readers prune its columns.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove a copy made by :func:`cut_lineage` that nothing reads any more."""
    spark, used = df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    made = _made_paths.get(spark.sparkContext.applicationId, [])
    for path in [p for p in made if any(u.endswith(p[p.index("/pedalgrid/") :]) for u in used)]:
        remove_path(spark, path)
        made.remove(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def store_bucketed(
    df: DataFrame, label: str, key: str, *sort: str, month_of: str | None = None, buckets: int | None = None
) -> DataFrame:
    """Like :func:`cut_lineage`, but bucketed by ``key`` for shuffle-free joins and windows.

    Use it only where no key can dominate (the dense grid: one row per key and bucket). With
    ``month_of`` the files also lie in folders by month of that column, in a column MONTH, which
    :func:`recent` uses to leave out the folders before a time. One task works on a bucket, so
    ``buckets`` should grow with the table; without it there are as many as a shuffle has partitions.
    """
    spark = df.sparkSession
    table = f"pedalgrid_{label}_{uuid.uuid4().hex}"
    writer = df.withColumn(MONTH, F.trunc(month_of, "month")) if month_of else df
    writer = writer.write.bucketBy(buckets or shuffle_width(spark), key).sortBy(key, *sort)
    if month_of:
        writer = writer.partitionBy(MONTH)
    writer.option("path", fresh_path(spark, label)).saveAsTable(table)
    _made_tables.setdefault(spark.sparkContext.applicationId, []).append(table)
    return spark.table(table)


def recent(df: DataFrame, time_col: str, since: Column) -> DataFrame:
    """Rows from ``since`` on; of a table stored by month only its folders from then on are read."""
    rows = df.filter(F.col(time_col) >= since)
    return rows.filter(F.col(MONTH) >= F.trunc(since, "month")) if MONTH in df.columns else rows
