"""Injected loaders of prices, benchmark returns and dividends, as data sources of a session.

Evaluations take their market data from loaders that the user supplies. A loader is a class: it is made from the options of the read,
``pieces(start, end)`` names what can hold rows of a span of days, and ``load(piece, start, end, sids)`` gives those rows as Arrow
batches. ``register`` turns it into a source of the session, so that ``spark.read.format(name)`` plans one task for each piece and each
task calls the loader for its piece alone. The span and the securities come from the options ``start``, ``end`` and ``sids``, or from
filters on ``date`` and ``sid`` where the session pushes filters down to Python sources (``spark.sql.python.filterPushdown.enabled``); both
reach ``pieces`` at planning, so months outside are neither listed nor opened.

``MonthlyFiles`` loads from a folder with a subfolder ``month=YYYY-MM`` of Parquet files for each month, as ``write_monthly`` writes it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

PRICES = "sid bigint, date date, close double"
BENCHMARKS = "date date, index_ret double, cdi double"
DIVIDENDS = "sid bigint, date date, value double, label string"
DAY = dt.timedelta(days=1)
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class MonthlyFiles:
    """Loads Parquet files in monthly folders below the option ``path``, by any file system that Arrow can open; a piece is a file."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def pieces(self, start: dt.date, end: dt.date) -> list[str]:
        store, base = fs.FileSystem.from_uri(self.path)
        months = [x for x in store.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.Directory and x.base_name.startswith("month=")]
        kept = [x for x in months if f"{start:%Y-%m}" <= x.base_name[6:] <= f"{end:%Y-%m}"]
        files = [f.path for x in kept for f in store.get_file_info(fs.FileSelector(x.path)) if f.path.endswith(".parquet")]
        return sorted(files)

    def load(self, piece: str, start: dt.date, end: dt.date, sids: list | None) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        # a folder's name is no column here, so that the file's own columns are all there is
        data = ds.dataset(piece, filesystem=store, format="parquet")
        rows = (pc.field("date") >= pa.scalar(start)) & (pc.field("date") <= pa.scalar(end))
        if sids is not None:
            rows = rows & pc.field("sid").isin(sids)
        yield from data.to_batches(filter=rows)


class Piece(InputPartition):
    pass


class _Reader(DataSourceReader):
    """Plans one task for each piece and keeps the span and the securities that were asked for."""

    def __init__(self, loader: type, options: dict[str, str], schema):
        self.loader, self.options = loader, options
        self.names = schema.names
        self.types = {f.name: f.dataType.simpleString() for f in schema}
        self.start = dt.date.fromisoformat(options.get("start", "0001-01-01"))
        self.end = dt.date.fromisoformat(options.get("end", "9999-12-31"))
        self.sids = self._typed(options["sids"].split(",")) if options.get("sids") else None

    def _typed(self, sids: list[str]) -> list:
        return [int(x) for x in sids] if self.types.get("sid") in ("bigint", "int") else sids

    def partitions(self) -> list[InputPartition]:
        if self.start > self.end:
            return []
        return [Piece(x) for x in self.loader(self.options).pieces(self.start, self.end)]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:  # nothing to read
            return
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "date": pa.date32(), "boolean": pa.bool_()}
        for batch in self.loader(self.options).load(partition.value, self.start, self.end, self.sids):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(c).cast(kinds[self.types[c]]) for c in self.names], self.names)


class _Pushing(_Reader):
    """Takes filters on date and security besides; Spark refuses such a reader where the session doesn't push filters down."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f: Filter) -> bool:
        """Whether the loader keeps exactly the rows that a filter keeps, so that Spark need not look again."""
        name = getattr(f, "attribute", ())
        if name == ("date",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                self.start = max(self.start, f.value)
            if isinstance(f, (EqualTo, LessThanOrEqual)):
                self.end = min(self.end, f.value)
            if isinstance(f, GreaterThan):
                self.start = max(self.start, f.value + DAY)
            if isinstance(f, LessThan):
                self.end = min(self.end, f.value - DAY)
            return True
        if name == ("sid",) and isinstance(f, (EqualTo, In)):
            wanted = [f.value] if isinstance(f, EqualTo) else list(f.value)
            wanted = [x for x in wanted if x is not None]  # a null in a list matches nothing
            self.sids = wanted if self.sids is None else [x for x in self.sids if x in wanted]
            return True
        return False


def source(kind: str, columns: str, loader: type, push: bool = False) -> type[DataSource]:
    """The data source of a loader, under the name ``kind`` with the given columns."""
    reads = _Pushing if push else _Reader

    class Loaded(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> DataSourceReader:
            return reads(loader, dict(self.options), schema)

    return Loaded


def register(spark: SparkSession, loader: type = MonthlyFiles, prices: str = "prices", benchmarks: str = "benchmarks", dividends: str = "dividends") -> None:
    """Registers a loader for the three kinds of market data; another call with other names adds another loader.

    Whether filters are taken is settled here, by the session's setting at this time.
    """
    push = spark.conf.get(PUSHDOWN, "false") == "true"
    for kind, columns in ((prices, PRICES), (benchmarks, BENCHMARKS), (dividends, DIVIDENDS)):
        spark.dataSource.register(source(kind, columns, loader, push))


def load(spark: SparkSession, kind: str, start: Any, end: Any, sids: list | None = None, **options: str) -> DataFrame:
    """Rows of a registered kind from ``start`` to ``end``, both included, of all securities or some.

    ``sids`` is a list that the caller knows, a basket say; a table of securities is joined instead.
    """
    reader = spark.read.format(kind).options(**options).option("start", str(start)).option("end", str(end))
    return (reader.option("sids", ",".join(map(str, sids))) if sids else reader).load()


def write_monthly(df: DataFrame, path: str) -> str:
    """Writes rows into monthly folders for ``MonthlyFiles``; rows of a month meet by security, so a large month has several files."""
    (df.withColumn("month", F.date_format("date", "yyyy-MM")).repartitionByRange("month", *(["sid"] if "sid" in df.columns else []), "date")
     .write.mode("overwrite").partitionBy("month").parquet(path))
    return path
