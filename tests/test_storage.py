"""What stored tables let a later query leave out."""

from helpers import at, poll_frame, status_frame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pedalgrid.operators import export, grid
from pedalgrid.plans.fleet import close, fleet
from pedalgrid.session import MONTH, fresh_path, recent, store_bucketed
from pedalgrid.sources import tables

DAY = 1440


def grid_of_months(spark):
    rows = [(s, at(d * DAY), d % 5) for s in "ABC" for d in range(0, 150, 2)]
    return spark.createDataFrame(rows, "station_id string, bucket timestamp, num_bikes_available int")


def files_read(df):
    return {f.split("/")[-2] for f in df.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}


def test_a_week_reads_its_month_only(spark):
    stored = store_bucketed(grid_of_months(spark), "t_months", "station_id", "bucket", month_of="bucket")
    since = stored.agg(F.max("bucket")).select(F.col("max(bucket)") - F.expr("interval 7 days")).scalar()
    week = recent(stored, "bucket", since)
    assert week.count() == 3 * 4
    assert all(f >= f"{MONTH}=2024-07" for f in files_read(week))
    plan = week._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_month" in plan or "_month" in plan.split("PartitionFilters:")[1][:200]
    assert export.window_buckets(stored).count() == 4


def test_windows_by_station_need_no_exchange(spark):
    stored = store_bucketed(grid_of_months(spark), "t_windows", "station_id", "bucket", month_of="bucket")
    before = F.lag("num_bikes_available").over(W.partitionBy("station_id").orderBy("bucket"))
    plan = stored.withColumn("p", before)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_mirror_has_a_folder_per_day(spark):
    path = fresh_path(spark, "t-mirror-days")
    rows = spark.createDataFrame([("a", at(d * DAY)) for d in range(5)], "k string, t timestamp")
    mirror = tables.mirror_incremental(rows, path, "t")
    assert mirror.columns == ["k", "t"]
    assert len(files_read(mirror)) == 5


def test_close_removes_what_was_stored(spark, tmp_path):
    f = fleet(spark, "/root/testdata/sf0.001")
    assert f.grid.count() > 0
    assert close(spark) > 0
    assert fleet(spark, "/root/testdata/sf0.001").grid.count() > 0


def file_sizes(spark, path, folder):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getLen() for f in store.listStatus(target) if f.getPath().getName().endswith(".parquet")]


def test_files_follow_the_size_of_a_month(spark):
    """A month of many times the advisory size is written by many tasks, a small one into one file; sorted by time."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(name, "64k")
    try:
        many = spark.range(0, 100_000, 1, 100).select(
            F.sha2(F.col("id").cast("string"), 256).alias("ride_id"),
            F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 2_000_000).alias("started_at"),
            F.when(F.col("id") % 1000 == 7, "202402").otherwise("202401").alias("source_month"),
        )
        path = fresh_path(spark, "t-sized")
        assert tables.load_months(many, path) == 2
    finally:
        spark.conf.unset(name)
    large, small = (file_sizes(spark, path, f"source_month={m}") for m in ("202401", "202402"))
    assert len(large) > 20 and len(small) <= 2
    for file in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().limit(3).collect():
        times = [r[0] for r in spark.read.parquet(file["f"]).select("started_at").collect()]
        assert times == sorted(times)
    assert tables.read_months(spark, path).count() == 100_000


def test_buckets_of_the_grid_grow_with_it(spark):
    """A task holds about as many rows of the dense grid however many stations and days there are."""
    status = status_frame(spark, [(f"s{i}", 0, 5, 2, 5) for i in range(40)])
    covered = grid.bucket_coverage(poll_frame(spark, range(0, 500, 5)))
    rows = 40 * covered.count()
    assert grid.grid_width(status, covered) == 8  # as a shuffle has
    wide = grid.grid_width(status, covered, task_rows=rows // 20)
    assert 20 <= wide <= 21
    plain = grid.grid_status(status, covered)
    dealt = grid.grid_status(status, covered, width=wide)
    assert dealt.rdd.getNumPartitions() == wide
    stored = store_bucketed(dealt, "t_wide", "station_id", "bucket", buckets=wide)
    assert stored.exceptAll(plain).isEmpty() and plain.exceptAll(stored).isEmpty()
    parts = stored.groupBy("station_id").count().rdd.getNumPartitions()
    assert parts == wide  # read bucket by bucket, without a shuffle
