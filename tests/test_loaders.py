"""Injected loaders as data sources: what is pruned, what is read, and results beside plain DataFrames."""
import datetime as dt
from collections import Counter

import pyarrow as pa
import pytest

from factorspark.sources import loaders as O

D = dt.date


@pytest.fixture(scope="module")
def prices(spark):
    rows = [(s, D(2020, 1, 1) + dt.timedelta(days=i), float(s * 1000 + i)) for s in (1, 2, 3) for i in range(366)]
    return spark.createDataFrame(rows, O.PRICES)


@pytest.fixture(scope="module")
def folder(prices, tmp_path_factory):
    return O.write_monthly(prices, str(tmp_path_factory.mktemp("loaders") / "prices"))


def test_all_rows_come_back(spark, prices, folder):
    O.register(spark)
    got = spark.read.format("prices").option("path", folder).load()
    assert got.schema == prices.schema
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, prices.collect()))


def test_a_span_opens_only_its_months(spark, prices, folder):
    O.register(spark)
    whole = O.load(spark, "prices", "2020-01-01", "2020-12-31", path=folder)
    part = O.load(spark, "prices", "2020-03-10", "2020-04-05", sids=[1, 3], path=folder)
    assert part.rdd.getNumPartitions() < whole.rdd.getNumPartitions() / 3
    want = prices.filter("date BETWEEN '2020-03-10' AND '2020-04-05' AND sid IN (1, 3)")
    assert Counter(map(tuple, part.collect())) == Counter(map(tuple, want.collect())) and part.count() == 54


@pytest.mark.parametrize("condition", ["date >= '2020-06-15' AND date < '2020-07-01'", "date = '2020-02-29'", "date > '2020-11-30' AND sid IN (2, 9)", "date <= '2020-01-01' AND sid = 1", "sid = 2 AND close > 2100",
                                       "date > '2021-05-01'", "date >= '2020-06-15' AND date < '2020-06-01'", "date = '2020-02-29' OR sid = 1", "sid IS NOT NULL AND date < '2020-01-20'"])
def test_filters_are_pushed_down(spark, prices, folder, condition):
    spark.conf.set(O.PUSHDOWN, "true")
    try:
        O.register(spark)
        got = spark.read.format("prices").option("path", folder).load().filter(condition)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, prices.filter(condition).collect()))
        if "OR" not in condition and "date" in condition:
            whole = spark.read.format("prices").option("path", folder).load()
            assert got.rdd.getNumPartitions() < whole.rdd.getNumPartitions()
    finally:
        spark.conf.unset(O.PUSHDOWN)
        O.register(spark)


def test_a_loader_of_ones_own(spark):
    class Computed:
        """One piece for each year; prices follow from the day."""

        def __init__(self, options):
            self.base = float(options["base"])

        def pieces(self, start, end):
            return list(range(max(start.year, 2019), min(end.year, 2022) + 1))

        def load(self, piece, start, end, sids):
            days = [d for i in range(366) if (d := D(piece, 1, 1) + dt.timedelta(days=i)).year == piece and start <= d <= end]
            for s in sids or [1, 2]:
                yield pa.record_batch({"date": pa.array(days, pa.date32()), "close": pa.array([self.base + s + d.toordinal() for d in days], pa.float64()), "sid": pa.array([s] * len(days), pa.int32())})

    O.register(spark, Computed, "p2", "b2", "d2")
    got = O.load(spark, "p2", "2020-12-30", "2021-01-02", sids=[7], base="0.5")
    assert got.rdd.getNumPartitions() == 2
    assert {(r.sid, r.date): r.close for r in got.collect()} == {(7, d): 7.5 + d.toordinal() for d in (D(2020, 12, 30), D(2020, 12, 31), D(2021, 1, 1), D(2021, 1, 2))}


def test_evaluation_with_loaders_equals_tables(spark):
    from __spark_entry__ import queries

    root = "/root/testdata/sf0.001"
    q = queries()
    walk = Counter(map(tuple, q["walk_forward"](spark, root).select("rec", "h", "entry_sno", "port", "n_missing").collect()))
    assert Counter(map(tuple, q["price_loader"](spark, root).collect())) == walk and walk
    bench = Counter(map(tuple, q["walk_forward"](spark, root).select("rec", "h", "index_ret", "cdi_ret", "alpha").collect()))
    assert Counter(map(tuple, q["bench_loader"](spark, root).collect())) == bench
    assert Counter(map(tuple, q["dividend_fetcher"](spark, root).collect())) == Counter(map(tuple, q["dividends_in_window"](spark, root).collect()))
