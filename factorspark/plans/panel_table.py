"""The factor panel as a table of months that is kept up to date.

A month of the panel depends on a bounded stretch of its inputs: the bars of the look-back and of the month after, the documents that can
still be in force, its members and their links. Each stretch has a mark: of bars, from the names, sizes and times of the files of each month,
without reading them; of documents, index and members, from sums of row hashes by month. A month is built anew if its mark differs from
the one it was built with, and only the bars of the months that such months need are opened. So one more month of bars costs
one look-back, whatever the length of the history.

Files are never changed: an update writes the months it builds below ``epoch=<n>``, and then a manifest with the mark and the epoch of each
month. Readers take the newest manifest, so a failed update leaves the table as it was.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.plans import panel as N

#: Months of bars before a month, for 252 sessions, a fill and a year of dividends; months for which a document can be in force.
BACK, DOCS_BACK = 20, 20
BARS = "sid bigint, date date, sno bigint, close double, tr_close double, volume double, ret double, dividend double"
_MANIFEST = "month string, mark string, at bigint, epoch bigint"


def _months_before(month: str, n: int) -> str:
    k = int(month[:4]) * 12 + int(month[5:]) - 1 - n
    return f"{k // 12:04d}-{k % 12 + 1:02d}"


def row_marks(df: DataFrame, month: str) -> dict[str, str]:
    """A mark of the rows of each month, whatever their order; one row for each month reaches the driver."""
    names = [F.col(c) for c in df.columns]
    sums = [F.sum(F.pmod(F.xxhash64(F.lit(seed), *names), F.lit(1 << 40))) for seed in (1, 2)]
    rows = df.groupBy(F.date_format(month, "yyyy-MM").alias("m")).agg(F.concat_ws("-", F.count("*"), *sums).alias("mark"))
    return {r["m"]: r["mark"] for r in rows.collect()}


@dataclass
class PanelTable:
    """A panel below ``folder`` over the monthly bar files below ``bars``; both on storage that all executors share."""

    spark: SparkSession
    folder: str
    bars: str
    back: int = BACK
    #: Months whose bars the last update opened.
    opened: list[str] = field(default_factory=list)

    def _fs(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def bar_marks(self) -> dict[str, str]:
        """A mark of the files of each month, from a listing."""
        store, place = self._fs(self.bars)
        marks = {}
        for folder in store.listStatus(place):
            name = folder.getPath().getName()
            if name.startswith("month="):
                files = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in store.listStatus(folder.getPath()) if not f.getPath().getName().startswith(("_", ".")))
                marks[name[6:]] = hashlib.sha256(repr(files).encode()).hexdigest()
        return marks

    def manifest(self) -> dict[str, tuple[str, int]]:
        """Mark and epoch of each month, of the newest manifest."""
        path = os.path.join(self.folder, "manifest")
        store, place = self._fs(path)
        if not store.exists(place):
            return {}
        rows = self.spark.read.schema(_MANIFEST).parquet(path)
        newest = rows.agg(F.max("epoch").alias("e")).first()["e"]
        return {r["month"]: (r["mark"], r["at"]) for r in rows.filter(F.col("epoch") == newest).collect()}

    def update(self, index: DataFrame, months: DataFrame, members: DataFrame, docs: DataFrame, doc_values: list[str], links: DataFrame, **settings) -> list[str]:
        """Builds the months whose inputs have changed and returns them; arguments as for ``panel.factor_panel``, ``index`` with its date.

        A month that is gone from ``months`` goes from the table.
        """
        held = self.manifest()
        keys = [c for c in ("t", "sid") if c in links.columns]
        marks = {"bars": self.bar_marks(), "index": row_marks(index, "date"), "docs": row_marks(docs, "available_from"),
                 "members": row_marks(members.select("t", "sid").join(links, keys, "left"), "t")}
        wanted = {}
        for r in months.filter(F.col("prev_sno") >= N.MIN_SESSIONS).filter("t_next IS NOT NULL").collect():  # a row for each month
            m = f"{r['month']:%Y-%m}"
            seen = {kind: [marks[kind].get(_months_before(m, k)) for k in range(first, last + 1)] for kind, first, last in (("bars", -1, self.back), ("index", -1, self.back), ("docs", 0, DOCS_BACK), ("members", 0, 0))}
            wanted[m] = hashlib.sha256(repr((tuple(r), seen, sorted(settings.items()), doc_values)).encode()).hexdigest()
        todo = sorted(m for m, mark in wanted.items() if held.get(m, ("", 0))[0] != mark)
        kept = {m: held[m] for m in wanted if m not in todo}
        self.opened = []
        if todo or kept.keys() != held.keys():
            epoch = 1 + max([at for _, at in held.values()], default=0)
            if todo:
                self._build(todo, epoch, index, months, members, docs, doc_values, links, set(marks["bars"]), settings)
            rows = [(m, *kept.get(m, (wanted[m], epoch)), epoch) for m in sorted(wanted)] or [("", "", epoch, epoch)]
            self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(os.path.join(self.folder, "manifest"))
        return todo

    def _build(self, todo: list[str], epoch: int, index, months, members, docs, doc_values, links, there: set[str], settings: dict) -> None:
        needed = {_months_before(m, k) for m in todo for k in range(-1, self.back + 1)}
        self.opened = sorted(needed & there)
        paths = [os.path.join(self.bars, f"month={m}") for m in self.opened]
        bars = self.spark.read.schema(BARS).parquet(*paths) if paths else self.spark.createDataFrame([], BARS)
        month = F.date_format("t", "yyyy-MM")
        built = N.factor_panel(bars, index.select("sno", "close"), months, members.filter(month.isin(todo)), docs, doc_values, links, **settings)
        built.withColumn("month", month).repartition("month").write.mode("overwrite").partitionBy("month").parquet(os.path.join(self.folder, "rows", f"epoch={epoch}"))

    def read(self) -> DataFrame:
        """The panel as of the newest manifest; the table must have been updated once."""
        root = os.path.join(self.folder, "rows")
        store, _ = self._fs(root)
        paths = [os.path.join(root, f"epoch={at}", f"month={m}") for m, (_, at) in sorted(self.manifest().items()) if m]
        paths = [p for p in paths if store.exists(self._fs(p)[1])]  # a month can be without rows
        return self.spark.read.parquet(*paths)
