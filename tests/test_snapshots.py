"""Partitions that are replaced all at once."""
import pytest
from pyspark.sql import functions as F

from factorspark.sources.snapshots import SnapshotTable, WriteConflict

SCHEMA = "v long, month string"


@pytest.fixture
def table(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), SCHEMA, ["month"])
    t.overwrite(spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None)], SCHEMA))
    return t


def rows(df):
    return sorted(((r.v, r.month) for r in df.collect()), key=str)


FIRST = [(1, "a b"), (2, "a b"), (3, "c"), (4, None)]


def test_only_the_partitions_with_rows_are_replaced(spark, table):
    before = table.read()
    assert table.overwrite(spark.createDataFrame([(9, "c"), (10, "d")], SCHEMA)) == 2
    assert rows(table.read()) == [(1, "a b"), (10, "d"), (2, "a b"), (4, None), (9, "c")]
    assert rows(before) == rows(table.read(1)) == FIRST
    assert table.overwrite(spark.createDataFrame([], SCHEMA)) == 2
    # a write that reads the table itself
    table.overwrite(table.read().withColumn("v", F.col("v") * 2))
    assert rows(table.read()) == [(18, "c"), (2, "a b"), (20, "d"), (4, "a b"), (8, None)]


def test_a_failed_write_leaves_the_old_version(spark, table):
    broken = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("v"), F.lit("c").alias("month"))
    with pytest.raises(Exception, match="lost"):
        table.overwrite(broken)
    assert table.versions() == [1] and rows(table.read()) == FIRST


def test_the_second_of_two_writers_fails(spark, table, monkeypatch):
    other = SnapshotTable(spark, table.folder, SCHEMA, ["month"])
    monkeypatch.setattr(other, "versions", lambda: [1])
    table.overwrite(spark.createDataFrame([(5, "c")], SCHEMA))
    with pytest.raises(WriteConflict):
        other.overwrite(spark.createDataFrame([(6, "c")], SCHEMA))
    assert (5, "c") in rows(table.read()) and (6, "c") not in rows(table.read())


def test_forgotten_versions_leave_what_is_live(spark, table):
    for v in (5, 6, 7):
        table.overwrite(spark.createDataFrame([(v, "c")], SCHEMA))
    assert table.forget(keep=2) == [1, 2] and table.versions() == [3, 4]
    assert rows(table.read()) == [(1, "a b"), (2, "a b"), (4, None), (7, "c")] and (6, "c") in rows(table.read(3))
    with pytest.raises(ValueError):
        table.read(1)


def test_an_empty_table(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "none"), SCHEMA, ["month"])
    assert t.read().columns == ["v", "month"] and t.read().count() == 0 and t.forget() == []
