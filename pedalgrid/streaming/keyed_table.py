"""A keyed table for endless upserts: small deltas per batch in hash buckets, merged by readers.

A batch that touches k keys writes those keys only, dealt to hash buckets. A manifest per version names the files that are
the table: per bucket one base and the deltas since. A reader takes the newest row of each key over them. When a bucket's
deltas outweigh its base, or are many, that bucket alone is rewritten. The manifest is written last and commits the
version; a batch id that is committed already changes nothing, one that broke off is written over. Manifests name
at most ``buckets * (most_deltas + 1)`` files, however large the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pedalgrid.functions.picking import latest_per
from pedalgrid.session import remove_path

BUCKET, VERSION = "_bucket", "_version"
MANIFEST = "bucket int, base boolean, version long, bytes long"


class KeyedTable:
    """``order`` decides which row of a key is the newest; of equal ones the later batch's is.

    ``share`` and ``most_deltas``: a bucket is rewritten when its deltas weigh more than that share of its base, or
    are that many. ``keep`` versions can still be read.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        schema: StructType,
        keys: Sequence[str],
        order: str,
        buckets: int = 16,
        share: float = 0.5,
        most_deltas: int = 8,
        keep: int = 2,
    ):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.keys, self.order, self.buckets = list(keys), order, buckets
        self.share, self.most_deltas, self.keep = share, most_deltas, keep
        self.stored = StructType([*schema.fields]).add(VERSION, "long")

    def _list(self, path: str) -> list:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        store = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return list(store.listStatus(target)) if store.exists(target) else []

    def _bytes(self, path: str) -> dict[int, int]:
        """Size by bucket of what a write has left below ``path``."""
        sizes = {}
        for bucket in self._list(path):
            name = bucket.getPath().getName()
            if name.startswith(f"{BUCKET}="):
                files = self._list(bucket.getPath().toString())
                sizes[int(name.split("=")[1])] = sum(f.getLen() for f in files)
        return sizes

    def versions(self) -> list[int]:
        """Committed versions that are kept, ascending."""
        found = []
        for entry in self._list(f"{self.folder}/manifest"):
            done = any(f.getPath().getName() == "_SUCCESS" for f in self._list(entry.getPath().toString()))
            if done:
                found.append(int(entry.getPath().getName()[1:]))
        return sorted(found)

    def manifest(self, version: int) -> list:
        """(bucket, base, version, bytes) of the files that are the table at ``version``."""
        rows = self.spark.read.schema(MANIFEST).json(f"{self.folder}/manifest/v{version}").collect()
        return sorted(rows, key=lambda r: (r["bucket"], r["version"]))

    def _path(self, base: bool, version: int) -> str:
        return f"{self.folder}/{'base' if base else 'delta'}/v{version}"

    def _rows(self, entries: list) -> DataFrame:
        paths = [f"{self._path(e['base'], e['version'])}/{BUCKET}={e['bucket']}" for e in entries]
        if not paths:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(*paths)

    def _newest(self, rows: DataFrame) -> DataFrame:
        return latest_per(rows, self.keys, F.struct(self.order, VERSION)).select(self.stored.names)

    def read(self, version: int | None = None) -> DataFrame:
        """The newest row of every key at a version, the last one if none is named."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else None
        elif version not in known:
            raise ValueError(f"version {version} is not kept")
        rows = self._rows([] if version is None else self.manifest(version))
        return self._newest(rows).select(self.schema.names)

    def _write(self, rows: DataFrame, base: bool, version: int) -> dict[int, int]:
        path = self._path(base, version)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        dealt = rows.withColumn(BUCKET, bucket).repartition(self.buckets, BUCKET)
        dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(path)
        return self._bytes(path)

    def _due(self, entries: list[tuple]) -> set[int]:
        """Buckets whose deltas are many, or heavy beside their base."""
        weight: dict[int, list] = {}
        for bucket, base, _, size in entries:
            own = weight.setdefault(bucket, [0, 0, 0])
            own[0 if base else 1] += size
            own[2] += not base
        return {b for b, (base, delta, n) in weight.items() if n >= self.most_deltas or (n > 1 and delta > self.share * base)}

    def apply(self, batch: DataFrame, version: int) -> bool:
        """Merge the rows of a batch; whether it was new. ``version`` is the id of the batch."""
        known = self.versions()
        if known and version <= known[-1]:
            return False
        before = self.manifest(known[-1]) if known else []
        entries = [(e["bucket"], e["base"], e["version"], e["bytes"]) for e in before]
        newest = self._newest(batch.select(self.schema.names).withColumn(VERSION, F.lit(version).cast("long")))
        entries += [(b, False, version, size) for b, size in self._write(newest, False, version).items()]
        due = self._due(entries)
        if due:
            old = [dict(zip(("bucket", "base", "version"), e[:3], strict=True)) for e in entries if e[0] in due]
            sizes = self._write(self._newest(self._rows(old)), True, version)
            entries = [e for e in entries if e[0] not in due] + [(b, True, version, n) for b, n in sizes.items()]
        made = self.spark.createDataFrame(entries, MANIFEST)
        made.coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest/v{version}")
        self._expire()
        return True

    def _expire(self) -> None:
        """Remove versions beyond ``keep`` and the files that no kept one names."""
        known = self.versions()
        gone, kept = known[: -self.keep], known[-self.keep :]
        used = {(e["base"], e["version"], e["bucket"]) for v in kept for e in self.manifest(v)}
        for base in (True, False):
            for entry in self._list(f"{self.folder}/{'base' if base else 'delta'}"):
                version = int(entry.getPath().getName()[1:])
                if version > kept[-1]:
                    continue
                path = self._path(base, version)
                unused = [b for b in self._bytes(path) if (base, version, b) not in used]
                for b in unused:
                    remove_path(self.spark, f"{path}/{BUCKET}={b}")
                if not self._bytes(path):
                    remove_path(self.spark, path)
        for v in gone:
            remove_path(self.spark, f"{self.folder}/manifest/v{v}")
