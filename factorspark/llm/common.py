"""Helpers that several operators share."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on, so that memory does not follow the batch size.
STEP_BYTES = 1 << 20
#: ASCII white space, the separators of words.
WHITE = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


_shipped: set[str] = set()


def ship(df: DataFrame) -> DataFrame:
    """Sends this package to the executors once for each application, so that their Python workers can import it."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='package-')}/{package.name}", "zip", package.parent, package.name))
        _shipped.add(context.applicationId)
    return df


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in a local session that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, so that later branches neither recompute nor differ."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint()


def text_key(text: str = "text") -> Column:
    """Stands for the text where rows that share a doc_id must be told apart."""
    return F.xxhash64(F.col(text))


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding it."""
    return column.cast(pa.binary()).to_pylist()


def steps(sizes: list[int], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Slices of consecutive rows of about ``limit`` bytes, one row at least."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the entropy of 64-bit values over all their bits; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def before(df: DataFrame, by: list[str], order: list[Column], spread: Column, chunks: int, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows that precede a row in its ``by`` group.

    ``spread`` is a number in [0, chunks) that must not fall along ``order``. A group is cut into these chunks: running sums
    inside one chunk, plus the chunk totals in front of it. So no task sees a whole group, whatever its size, and the totals
    (groups times ``chunks`` rows) are pre-aggregated before they are exchanged.
    """
    d = df.withColumn("__chunk", spread.cast("int")).withColumn("__value", value)
    sums = d.groupBy(*by, "__chunk").agg(F.sum("__value").alias("__sum"))
    ahead = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__chunk").alias("__c"),
                       F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__ahead"))
    inside = Window.partitionBy(*by, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    match = F.col("__chunk") == F.col("__c")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return d.join(sums, match).withColumn(name, F.col("__ahead") + F.col("__inside")).drop("__chunk", "__value", "__c", "__ahead", "__inside", "__sum", *[f"__by_{c}" for c in by])


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node reaches: ``(u, v)`` pairs of longs in, ``(node, root)`` out, nodes without a link left out.

    Large-star and small-star steps in turn, each a pre-aggregated minimum joined back, until nothing moves. The rounds grow with
    the logarithm of the longest path; every round ends in a checkpoint.
    """
    def step(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        e = e.join(low, F.col("u") == F.col("w"))
        if large:
            return e.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = e.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return below.unionByName(low.filter("w != m").select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()

    e = settle(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        seen = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == seen or not seen["n"]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
        e = settle(step(step(e, True), False))
