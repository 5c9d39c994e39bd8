"""Tables whose readers see one version or another, never a half-written one: data folders, and a manifest that names the live ones.

A write puts its rows into new folders and, last of all, a manifest with the next number: a small JSON-lines table whose
commit marker makes it count. So a reader that has opened a version keeps it while newer ones are written; a writer that dies
leaves folders that no manifest names; of two writers of one number the second fails.

Each partition carries the number of the extraction that wrote it. `rebuild` writes anew only those that an older one wrote.
Restoring an old version is a new manifest with the old one's folders. Pruning removes old manifests, then the folders that
none of the rest names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "part string, folder string, extraction int, rows long"


class VersionedTable:
    """A table under a folder on shared storage, in partitions by the text of one column."""

    def __init__(self, spark: SparkSession, path: str, partition: str):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition

    def _fs(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs()
        where = path(f"{self.path}/{folder}")
        return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []

    def versions(self) -> list[int]:
        """Numbers of the whole versions, in order."""
        fs, path = self._fs()
        return sorted(int(n) for n in self._names("manifests") if n.isdigit() and fs.exists(path(f"{self.path}/manifests/{n}/_SUCCESS")))

    def manifest(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise ValueError(f"no version {version if version is not None else ''} under {self.path}")
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifests/{known[-1] if version is None else version}")

    def read(self, version: int | None = None) -> DataFrame:
        folders = [r["folder"] for r in self.manifest(version).select("folder").distinct().collect()]  # one folder a write that is still alive
        live = self.manifest(version).select(F.col("part").alias("_part"), F.col("folder").alias("_folder"))
        if not folders:
            raise ValueError(f"the version has no rows under {self.path}")
        rows = self.spark.read.parquet(*(f"{self.path}/data/{f}" for f in folders))
        at = F.regexp_extract(F.col("_metadata.file_path"), r"/data/([0-9a-f]+)/", 1)
        keyed = rows.withColumn("_folder", at).withColumn("_part", F.coalesce(F.col(self.partition).cast("string"), F.lit("")))
        return keyed.join(F.broadcast(live), ["_part", "_folder"], "left_semi").drop("_part", "_folder")  # a row a partition

    def _publish(self, manifest: DataFrame) -> int:
        number = (self.versions() or [0])[-1] + 1
        manifest.coalesce(1).write.mode("errorifexists").json(f"{self.path}/manifests/{number}")
        return number

    def write(self, rows: DataFrame, extraction: int, keep_others: bool = True) -> int:
        """Replaces the partitions that rows have (all partitions without keep_others) and gives the new version's number."""
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        part = F.coalesce(F.col(self.partition).cast("string"), F.lit(""))
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{folder}").groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
        fresh = written.select("part", F.lit(folder).alias("folder"), F.lit(extraction).alias("extraction"), "rows")
        if keep_others and self.versions():
            fresh = self.manifest().join(written.select("part"), "part", "left_anti").select(*fresh.columns).unionByName(fresh)
        return self._publish(fresh)

    def stale(self, extraction: int) -> DataFrame:
        """Partitions that an older extraction wrote."""
        return self.manifest().where(F.col("extraction") < extraction).select("part")

    def rebuild(self, extraction: int, build: Callable[[DataFrame], DataFrame]) -> int | None:
        """Writes the stale partitions anew from build(their names); None where nothing is stale."""
        parts = self.stale(extraction)
        return None if parts.limit(1).count() == 0 else self.write(build(parts), extraction)

    def restore(self, version: int) -> int:
        """The version as the newest one; what it replaces stays there to go back to."""
        return self._publish(self.manifest(version))

    def prune(self, keep: int) -> list[int]:
        """Removes all but the newest `keep` versions, and data that only those named."""
        if keep < 1:
            raise ValueError("at least one version must be kept")
        fs, path = self._fs()
        old, kept = self.versions()[:-keep], self.versions()[-keep:]
        live = {r["folder"] for v in kept for r in self.manifest(v).select("folder").distinct().collect()}
        named = live | {r["folder"] for v in old for r in self.manifest(v).select("folder").distinct().collect()}
        for v in old:
            fs.delete(path(f"{self.path}/manifests/{v}"), True)
        for f in named - live:  # folders of a write that is still under way are named nowhere, and stay
            fs.delete(path(f"{self.path}/data/{f}"), True)
        return old
