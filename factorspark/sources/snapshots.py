"""A partitioned table whose readers see a write as a whole or not at all.

A write stages its partitions in a folder of its own, ``data/stage=<id>``, and at last puts a manifest in place, under the next version number,
that names the stage of every live partition. Readers resolve the newest manifest. Files are never changed, so a frame that
was opened before a write goes on reading its version, and a write that fails leaves files that no manifest names. Two writers that
start from the same version cannot both commit: the manifest's name is taken by a rename that fails if it is there.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class WriteConflict(RuntimeError):
    """Another writer committed first; nothing of this write is visible."""


class SnapshotTable:
    """The table in a folder that all executors share. ``schema`` holds the partition columns ``by`` too.

    A manifest has a line for each partition, so the driver handles as many names as there are partitions.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str | T.StructType, by: list[str]):
        self.spark, self.folder, self.by = spark, folder, by
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path(os.path.join(self.folder, *names))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def _names(self, *at: str) -> list[str]:
        path = self._path(*at)
        return [s.getPath().getName() for s in self._fs().listStatus(path)] if self._fs().exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._names("manifest") if n.startswith("v"))

    def live(self, version: int | None) -> dict[str, str]:
        """Folder of each partition, as ``column=value`` steps, and the stage that holds it."""
        if not version:
            return {}
        lines = self.spark.read.text(str(self._path("manifest", f"v{version:012d}"))).collect()
        return dict(r["value"].split("\t") for r in lines if r["value"])

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or an earlier one that is still kept. Partition filters prune as in any partitioned table."""
        there = self.versions()
        if version is not None and version not in there:
            raise ValueError(f"no version {version}; there are {there}")
        live = self.live(version or max(there, default=None))
        if not live:
            return self.spark.createDataFrame([], self.schema)
        base = str(self._path("data"))
        paths = [os.path.join(base, f"stage={stage}", part) for part, stage in sorted(live.items())]
        kept = T.StructType([*self.schema.fields, T.StructField("stage", T.StringType())])
        return self.spark.read.schema(kept).option("basePath", base).parquet(*paths).select(*self.schema.names)

    def overwrite(self, df: DataFrame) -> int:
        """Replaces the partitions that ``df`` has rows in, all at once, and returns the version; without rows nothing changes.

        ``df`` may read the table itself.
        """
        before = max(self.versions(), default=0)
        stage = uuid.uuid4().hex
        df.select(*self.schema.names).repartition(*self.by).write.partitionBy(*self.by).parquet(str(self._path("data", f"stage={stage}")))
        new = self._partitions(stage)
        if not new:
            return before
        self._commit({**self.live(before), **dict.fromkeys(new, stage)}, before + 1)
        return before + 1

    def _partitions(self, stage: str) -> list[str]:
        found = [""]
        for _ in self.by:
            found = [os.path.join(at, n) for at in found for n in self._names("data", f"stage={stage}", at) if "=" in n]
        return found

    def _commit(self, live: dict[str, str], version: int) -> None:
        draft, place = self._path("manifest", f".{uuid.uuid4().hex}"), self._path("manifest", f"v{version:012d}")
        out = self._fs().create(draft, False)
        out.write(bytearray("\n".join(f"{part}\t{stage}" for part, stage in sorted(live.items())), "utf-8"))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), self._conf)
        if self._fs().exists(place):
            raise WriteConflict(f"version {version} is there")
        try:
            context.rename(self._fs().makeQualified(draft), self._fs().makeQualified(place), options)
        except Exception as e:
            if self._fs().exists(place):
                raise WriteConflict(f"version {version} is there") from e
            raise

    def forget(self, keep: int = 2) -> list[int]:
        """Drops all but the newest ``keep`` versions with the partitions that only they name; returns the versions dropped.

        Stages without a manifest stay, as a writer may be at work on them.
        """
        there = self.versions()
        old, kept = there[: max(0, len(there) - max(1, keep))], there[-max(1, keep) :]
        needed = {p for v in kept for p in self.live(v).items()}
        for v in old:
            for part, stage in set(self.live(v).items()) - needed:
                self._fs().delete(self._path("data", f"stage={stage}", part), True)
        for v in old:
            self._fs().delete(self._path("manifest", f"v{v:012d}"), False)
        return old
