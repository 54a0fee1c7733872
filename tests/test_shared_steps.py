"""Steps that every fleet query pays for."""

import bisect
import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pedalgrid.functions.ordered import slice_of
from pedalgrid.session import cut_lineage


def test_slices_without_a_struct_per_step(spark):
    """Same places as a plain search for any number of bounds, and one number carried through it."""
    for n in (1, 2, 3, 7, 8, 9, 23, 200):
        bounds = sorted({i * 37 % 211 for i in range(n)})
        rows = spark.range(-3, 215).select("id", slice_of(F.col("id"), bounds).alias("s"))
        assert all(r.s == bisect.bisect_right(bounds, r.id) for r in rows.collect())
        assert "struct" not in rows._jdf.queryExecution().analyzed().toString()


def test_instants_are_stored_in_64_bits(spark):
    stored = cut_lineage(spark.sql("SELECT timestamp'2024-01-01 00:00:00.123456' AS at"), "instants")
    kinds = {pq.ParquetFile(f).schema.column(0).physical_type for f in glob.glob(f"{stored.inputFiles()[0].removeprefix('file://').rsplit('/', 1)[0]}/*.parquet")}
    assert kinds == {"INT64"}
    assert stored.select(F.unix_micros("at")).first()[0] == 1704067200123456
