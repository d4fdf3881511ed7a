"""A table of NAV points that a stream keeps up to date in place.

Points lie in partitions of a bucket of curves and a month. A batch changes some points; the levels of these curves from the first
change on follow, so the partitions from that month on are written anew for the buckets concerned, and no others. The level and
the last known rate of every curve before that month are carried on from ``closing``, which has a row for each curve and month.

Files are never changed. A batch writes its partitions below ``epoch=<batch>`` and at last the manifest of that epoch, which names for every
partition the epoch that holds it. Readers take the newest manifest, so they see a batch as a whole or not at all; a batch that failed half
way leaves files that no manifest names, and one that is replayed after its manifest is there changes nothing.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorspark.operators import timeseries as ts

BUCKETS = 16
POINT = "curve long, date date, version long, provisional boolean, port_ret double, index_ret double, cdi_ret double"
LEVELS = ("nav", "index_nav", "cdi_nav")
_ROW = f"{POINT}, {', '.join(f'{c} double' for c in LEVELS)}, rate double, bucket int, month string"
_CLOSING = f"curve long, {', '.join(f'{c} double' for c in LEVELS)}, rate double, bucket int, month string"
_MANIFEST = "bucket int, month string, at long"
_RETURNS = ["port_ret", "index_ret", "cdi_ret"]


@dataclass
class NavTable:
    """The table in a folder that all executors share."""

    spark: SparkSession
    folder: str
    buckets: int = BUCKETS

    def _path(self, *names: str) -> str:
        return os.path.join(self.folder, *names)

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def epoch(self, before: int | None = None) -> int | None:
        """The newest epoch that is complete, of those before a batch if one is given."""
        if not self._exists(self._path("manifest")):
            return None
        done = self.spark.read.schema("epoch long").parquet(self._path("manifest")).select("epoch")
        return (done if before is None else done.filter(F.col("epoch") < before)).agg(F.max("epoch").alias("e")).first()["e"]

    def live(self, epoch: int | None) -> list[tuple[int, str, int]]:
        """Bucket, month and epoch of the files of each partition; as many rows as there are partitions."""
        if epoch is None:
            return []
        rows = self.spark.read.schema(f"{_MANIFEST}, epoch long").parquet(self._path("manifest")).filter(F.col("epoch") == epoch)
        return sorted((r["bucket"], r["month"], r["at"]) for r in rows.collect() if r["bucket"] is not None)

    def _read(self, kind: str, schema: str, parts: list[tuple[int, str, int]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        paths = [self._path(kind, f"epoch={at}", f"bucket={bucket}", f"month={month}") for bucket, month, at in parts]
        read = self.spark.read.schema(schema + ", epoch long").option("basePath", self._path(kind)).parquet(*paths)
        return read.drop("epoch")

    def points(self, epoch: int | None = None) -> DataFrame:
        """All points with their levels, as of the newest epoch or an earlier one."""
        return self._read("points", _ROW, self.live(self.epoch() if epoch is None else epoch)).drop("bucket", "month")

    def _placed(self, points: DataFrame) -> DataFrame:
        return points.withColumn("bucket", F.pmod(F.xxhash64("curve"), F.lit(self.buckets)).cast("int")).withColumn("month", F.date_format("date", "yyyy-MM"))

    def apply(self, batch: DataFrame, epoch: int, trading: DataFrame | None = None, window_start: str | None = None) -> int:
        """Merges a batch of points (the columns of POINT) and returns how many partitions it wrote.

        Of several points of a curve and day a final one beats a provisional one, then the batch beats what is there, then the
        higher version wins. A point that brings no new return and no other state changes nothing. With ``trading`` (date), points from
        ``window_start`` on that lie on days without a session go.
        """
        earlier = self.epoch(before=epoch)
        if self.epoch() is not None and (self.epoch() or 0) >= epoch:
            return 0
        live = self.live(earlier)
        known = [c.split(" ")[0] for c in POINT.split(", ")]
        new = best(self._placed(batch.select(*known))).persist()
        months = {(r["bucket"], r["month"]) for r in new.select("bucket", "month").distinct().collect()}
        looked = [p for p in live if (p[0], p[1]) in months]
        old = self._read("points", _ROW, looked).select(*known, "bucket", "month")
        won = best(old.withColumn("_rank", F.lit(0)).unionByName(new.withColumn("_rank", F.lit(1))), "_rank")
        state = F.struct(*_RETURNS, F.coalesce("provisional", F.lit(False)).alias("p"))
        before = old.select(F.col("curve").alias("_c"), F.col("date").alias("_d"), state.alias("_s"))
        changed = won.join(before, (F.col("curve") == F.col("_c")) & (F.col("date") == F.col("_d")), "left").filter(F.col("_c").isNull() | (F.col("_s") != state)).select(*known, "bucket", "month")
        gone = None
        if trading is not None:
            closed = self._read("points", _ROW, [p for p in live if window_start is None or p[1] >= window_start[:7]]).select("curve", "date", "bucket", "month")
            open_days = trading.select("date").distinct()
            late = F.lit(True) if window_start is None else F.col("date") >= F.lit(window_start).cast("date")
            gone = closed.filter(late).join(open_days, "date", "left_anti").select("curve", "date", "bucket", "month")
            changed = changed.withColumn("_late", late).join(open_days.withColumn("_open", F.lit(True)), "date", "left").filter("NOT _late OR _open").drop("_late", "_open")
        touched = changed.select("bucket", "month") if gone is None else changed.select("bucket", "month").unionByName(gone.select("bucket", "month"))
        first = {r["bucket"]: r["month"] for r in touched.groupBy("bucket").agg(F.min("month").alias("month")).collect()}
        kept = [p for p in live if p[0] not in first or p[1] < first[p[0]]]
        if first:
            self._write(changed, gone, [p for p in live if p[0] in first and p[1] >= first[p[0]]], [p for p in kept if p[0] in first], epoch)
        written = [(r["bucket"], r["month"], epoch) for r in self._partitions(epoch)] if first else []
        rows = [(*p, epoch) for p in sorted(kept + written)] or [(None, None, None, epoch)]
        self.spark.createDataFrame(rows, f"{_MANIFEST}, epoch long").coalesce(1).write.mode("append").parquet(self._path("manifest"))
        new.unpersist()
        return len(written)

    def _partitions(self, epoch: int) -> list:
        path = self._path("closing", f"epoch={epoch}")
        if not self._exists(path):
            return []
        return self.spark.read.schema(_CLOSING).option("basePath", path).parquet(path).select("bucket", "month").distinct().collect()

    def _write(self, changed: DataFrame, gone: DataFrame | None, again: list, ahead: list, epoch: int) -> None:
        """Partitions from the first change on: what is there beside the changes, chained on from the levels before."""
        known = changed.columns
        keys = ["curve", "date"]
        rest = self._read("points", _ROW, again).select(*known).join(changed.select(*keys), keys, "left_anti")
        if gone is not None:
            rest = rest.join(gone.select(*keys), keys, "left_anti")
        carried = self._read("closing", _CLOSING, ahead).groupBy("curve").agg(F.max_by(F.struct(*LEVELS, "rate"), "month").alias("c"))
        rows = chain(rest.unionByName(changed), carried)
        path = f"epoch={epoch}"
        rows.repartition("bucket", "month").write.mode("overwrite").partitionBy("bucket", "month").parquet(self._path("points", path))
        # from what was written, so that both hold the same levels
        stored = self.spark.read.schema(_ROW).option("basePath", self._path("points", path)).parquet(self._path("points", path)) if self._exists(self._path("points", path)) else rows
        closing = stored.groupBy("bucket", "month", "curve").agg(F.max_by(F.struct(*LEVELS, "rate"), "date").alias("c")).select("curve", "c.*", "bucket", "month")
        closing.repartition("bucket", "month").write.mode("overwrite").partitionBy("bucket", "month").parquet(self._path("closing", path))


def best(points: DataFrame, rank: str | None = None) -> DataFrame:
    """One point of each curve and day: final before provisional, then by ``rank``, then by version."""
    rest = [c for c in points.columns if c not in ("curve", "date", rank)]
    order = F.struct((~F.coalesce("provisional", F.lit(False))).alias("a"), (F.col(rank) if rank else F.lit(0)).alias("b"), F.col("version").alias("c"))
    return points.groupBy("curve", "date").agg(F.max_by(F.struct(*rest), order).alias("r")).select("curve", "date", "r.*")


def chain(points: DataFrame, carried: DataFrame) -> DataFrame:
    """Levels from returns, on from the carried ones (100 for a new curve); ``rate`` is the last known rate.

    A null return does not move a level; a null rate on a settled session takes the last known rate.
    """
    w = Window.partitionBy("curve").orderBy("date")
    p = points.join(carried, "curve", "left")
    known = F.coalesce(F.last("cdi_ret", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("c.rate"))
    settled = ~F.coalesce("provisional", F.lit(False)) & F.col("index_ret").isNotNull()
    p = p.withColumn("rate", known).withColumn("_cdi", F.coalesce("cdi_ret", F.when(settled, F.col("rate"))))
    for name, ret in zip(LEVELS, ("port_ret", "index_ret", "_cdi"), strict=True):
        p = p.withColumn(name, F.coalesce(F.col("c")[name], F.lit(100.0)) / 100 * ts.chain(F.col(ret), w))
    return p.select(*points.columns, *LEVELS, "rate")


def start(points: DataFrame, folder: str, buckets: int = BUCKETS, after: Callable[[int, int], None] | None = None):
    """Streams points into the table below ``folder``; ``after`` hears of each batch and of the partitions that it wrote."""
    def apply(batch: DataFrame, epoch: int) -> None:
        wrote = NavTable(batch.sparkSession, os.path.join(folder, "nav"), buckets).apply(batch, epoch)
        if after:
            after(epoch, wrote)

    return points.writeStream.outputMode("append").option("checkpointLocation", os.path.join(folder, "nav-state")).trigger(availableNow=True).foreachBatch(apply).start()
