"""Query registry: each entry pairs a Spark plan with the SQL that states the same result."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.catalog.prelude import with_prelude
from factorspark.session import prepare
from factorspark.sources.derived import Tables

# Output types: (Spark type, SQL type). A digit means a double rounded to that many places.
_TYPES = {"i": ("bigint", "BIGINT"), "s": ("string", "VARCHAR"), "t": ("date", "DATE"),
          "b": ("boolean", "BOOLEAN"), "ts": ("timestamp", "TIMESTAMP")}


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None

    def run(self, spark: SparkSession, root: str) -> DataFrame:
        df = self.build(Tables(prepare(spark), root))
        cols = []
        for name, kind in self.columns:
            c = F.col(name)
            if kind in _TYPES:
                cols.append(c.cast(_TYPES[kind][0]).alias(name))
            elif kind == "raw":
                cols.append(c)
            else:
                # adding zero turns a negative zero into a plain one
                cols.append((F.round(F.when(~F.isnan(c.cast("double")), c.cast("double")), int(kind)) + F.lit(0.0)).alias(name))
        return df.select(*cols)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = []
        for name, kind in self.columns:
            if kind in _TYPES:
                cols.append(f"CAST({name} AS {_TYPES[kind][1]}) AS {name}")
            else:
                cols.append(f"round(CAST({name} AS DOUBLE), {kind}) + 0.0 AS {name}")
        return with_prelude(f"SELECT {', '.join(cols)} FROM result", result=self.sql)


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Registers a plan builder ``Tables -> DataFrame``.

    ``columns`` lists ``name:kind`` items; both engines cast and round to these at the output.
    """
    parsed = tuple(tuple(re.split(":", item)) for item in columns.split())

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, parsed, sql)
        return fn

    return wrap
