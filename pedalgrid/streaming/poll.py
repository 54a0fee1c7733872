"""The poller as one streaming job: snapshots in, change log, current state and poll log out.

Each micro-batch of snapshots is compared with the current state; changed rows go to the log, the newest ones to the
current state, and what every poll saw to the poll log. The three sinks and a ledger are written in this order, each
under the id of the micro-batch. Only the ledger commits: readers see what it lists, and a batch that broke
off between two sinks is run again from the state its predecessor committed, writing the same over what is there.
Polls come in order; where they do not, :mod:`pedalgrid.streaming.keyed` puts them in order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

from pedalgrid.constants import STATE_FIELDS
from pedalgrid.functions.picking import first_per
from pedalgrid.operators.cdc import cdc_flags
from pedalgrid.session import cut_lineage, forget
from pedalgrid.streaming.keyed_table import KeyedTable

LEDGER = "batch long, rows_seen long, rows_written long"
POLLS = "polled_at timestamp, stations_seen long, rows_written long, unchanged long"


class PollMetrics(StreamingQueryListener):
    """Keeps what the last micro-batches of all queries observed: (batch id, metrics by name)."""

    def __init__(self, most: int = 1000):
        self.seen: deque = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        metrics = {name: row.asDict() for name, row in event.progress.observedMetrics.items()}
        if metrics:
            self.seen.append((event.progress.batchId, metrics))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


class PollTables:
    """The three tables of a poller and the ledger over them, in one folder."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        schema: StructType,
        key: str = "station_id",
        time_col: str = "polled_at",
        fields: Sequence[str] = STATE_FIELDS,
    ):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.key, self.time_col, self.fields = key, time_col, list(fields)
        state = StructType([f for f in schema.fields if f.name in (key, time_col, *fields)])
        self.state = KeyedTable(spark, f"{self.folder}/current", state, [key], time_col)

    def committed(self) -> list[int]:
        """Ids of the micro-batches that are complete, ascending."""
        found = self.state._list(f"{self.folder}/ledger")
        done = [e for e in found if any(f.getPath().getName() == "_SUCCESS" for f in self.state._list(e.getPath().toString()))]
        return sorted(int(e.getPath().getName().split("=")[1]) for e in done)

    def _read(self, table: str, schema) -> DataFrame:
        """Rows of the committed micro-batches; the folder of each carries its id."""
        ids = self.committed()
        if not ids:
            return self.spark.createDataFrame([], schema)
        whole = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{table}")
        return whole.parquet(*(f"{self.folder}/{table}/batch={i}" for i in ids))

    def changes(self) -> DataFrame:
        return self._read("changes", self.schema).select(self.schema.names)

    def polls(self) -> DataFrame:
        """One row per poll, as the first micro-batch saw it: a poll that came again changes nothing."""
        rows = self._read("polls", POLLS)
        return first_per(rows, ["polled_at"], "batch").drop("batch") if self.committed() else rows

    def current(self, after: int | None = None) -> DataFrame:
        ids = self.committed()
        if not ids:
            return self.spark.createDataFrame([], self.state.schema)
        return self.state.read(ids[-1] if after is None else after)

    def ledger(self) -> DataFrame:
        """(batch, rows_seen, rows_written) of the committed micro-batches."""
        return self.spark.read.schema(LEDGER).json([f"{self.folder}/ledger/batch={i}" for i in self.committed()])

    def _commit(self, flags: DataFrame, batch_id: int) -> None:
        total = flags.agg(
            F.lit(batch_id).cast("long").alias("batch"),
            F.count("*").alias("rows_seen"),
            F.count_if("changed").alias("rows_written"),
        )
        total.coalesce(1).write.mode("overwrite").json(f"{self.folder}/ledger/batch={batch_id}")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of snapshot rows; to be run again with the same id after a failure."""
        ids = self.committed()
        if ids and batch_id <= ids[-1]:
            return
        # The state goes before a key's rows, as one more row; what is not after it came before.
        known = self.current()
        times = known.select(self.key, F.col(self.time_col).alias("_at"))
        new = batch.dropDuplicates([self.key, self.time_col]).join(times, self.key, "left")
        new = new.filter(F.col("_at").isNull() | (F.col(self.time_col) > F.col("_at"))).select(*self.schema.names)
        rows = new.withColumn("_known", F.lit(False)).unionByName(
            known.withColumn("_known", F.lit(True)), allowMissingColumns=True
        )
        rows = cut_lineage(rows, "poll")
        flags = cdc_flags(rows, self.key, self.time_col, self.fields).filter("NOT _known").drop("_known")
        flags = cut_lineage(flags, "poll-flags")
        changed = flags.filter("changed").drop("changed")
        changed.write.mode("overwrite").parquet(f"{self.folder}/changes/batch={batch_id}")
        self.state.apply(changed, batch_id)
        polls = flags.groupBy(F.col(self.time_col).alias("polled_at")).agg(
            F.count("*").alias("stations_seen"), F.count_if("changed").alias("rows_written")
        )
        polls = polls.withColumn("unchanged", F.col("stations_seen") - F.col("rows_written"))
        polls.write.mode("overwrite").parquet(f"{self.folder}/polls/batch={batch_id}")
        self._commit(flags, batch_id)
        for copy in (rows, flags):
            forget(copy)


def run_polls(snapshots: DataFrame, tables: PollTables) -> PollMetrics:
    """Process the snapshots that are there; what a stop or a failure has left is gone on with by the next call."""
    spark = tables.spark
    metrics = PollMetrics()
    observed = snapshots.observe(
        "poll", F.count("*").alias("rows_seen"), F.max(tables.time_col).alias("last_polled")
    )
    spark.streams.addListener(metrics)
    try:
        query = (
            observed.writeStream.foreachBatch(tables.write)
            .option("checkpointLocation", f"{tables.folder}/progress")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.streams.removeListener(metrics)
    return metrics
