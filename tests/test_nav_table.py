"""The NAV table: reconciling, what a batch writes, replays, and streams against one merge of all points."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from factorspark.streaming import jobs as J
from factorspark.streaming.nav_table import POINT, NavTable, start


def pt(date, port, index, cdi=0.0005, provisional=False, curve=1, version=0):
    return (curve, dt.date.fromisoformat(date), version, provisional, port, index, cdi)


@pytest.fixture()
def table(spark, tmp_path):
    return NavTable(spark, str(tmp_path / "nav"), 4)


def put(table, epoch, points, **window):
    return table.apply(table.spark.createDataFrame(points, POINT), epoch, **window)


def rows(table, curve=1):
    return table.points().filter(f"curve = {curve}").orderBy("date").collect()


def test_provisional_point_is_reconciled_and_levels_are_chained_again(table):
    put(table, 0, [pt("2026-10-01", 0.01, 0.02)])
    put(table, 1, [pt("2026-10-02", None, None, None, True)])
    a, b = rows(table)
    assert b.provisional and (b.nav, b.cdi_nav) == (a.nav, a.cdi_nav)
    put(table, 2, [pt("2026-10-02", 0.03, 0.01), pt("2026-10-05", -0.01, 0.0)])
    s = rows(table)
    assert [str(p.date) for p in s] == ["2026-10-01", "2026-10-02", "2026-10-05"] and not s[1].provisional
    assert s[1].nav == pytest.approx(100 * 1.01 * 1.03) and s[2].nav == pytest.approx(100 * 1.01 * 1.03 * 0.99)
    assert s[2].index_nav == pytest.approx(100 * 1.02 * 1.01)


def test_final_close_replaces_preliminary_value(table):
    put(table, 0, [pt("2026-10-01", 0.01, 0.02)])
    put(table, 1, [pt("2026-10-01", 0.05, 0.05)])
    assert [p.port_ret for p in rows(table)] == [0.05]


def test_window_drops_points_on_days_without_a_session(table, spark):
    put(table, 0, [pt("2026-09-30", 0.0, 0.0), pt("2026-10-02", 0.004, 0.0046), pt("2026-10-03", 0.019, 0.0263), pt("2026-10-06", 0.038, 0.077, provisional=True)])
    days = spark.createDataFrame([(dt.date(2026, 9, 30),), (dt.date(2026, 10, 2),), (dt.date(2026, 10, 5),), (dt.date(2026, 10, 6),)], "date date")
    put(table, 1, [pt("2026-10-02", 0.019, 0.0263), pt("2026-10-05", 0.038, 0.077), pt("2026-10-06", None, None, None, True)], trading=days, window_start="2026-09-24")
    s = rows(table)
    assert [str(p.date) for p in s] == ["2026-09-30", "2026-10-02", "2026-10-05", "2026-10-06"]
    assert s[-1].provisional and s[-1].index_nav == pytest.approx(100 * 1.0263 * 1.077)


def test_null_rate_on_a_settled_day_uses_the_last_one_across_months(table):
    put(table, 0, [pt("2026-09-30", 0.0, 0.0, 0.0006)])
    put(table, 1, [pt("2026-10-02", 0.0, 0.0, None)])
    s = rows(table)
    assert s[1].cdi_ret is None and s[1].cdi_nav == pytest.approx(100 * 1.0006**2)


def year(curves):
    return [pt(str(dt.date(2026, 1, 1) + dt.timedelta(days=i)), 0.001 * (c + 1), 0.002, curve=c) for c in curves for i in range(0, 360, 3)]


def test_a_batch_writes_only_the_partitions_it_changes(table):
    whole = put(table, 0, year(range(20)))
    assert whole == 12 * len({p[0] for p in table.live(0)})
    before = {p[:2]: p[2] for p in table.live(0)}
    wrote = put(table, 1, [pt("2026-11-01", 0.5, 0.0, curve=3)])
    after = {p[:2]: p[2] for p in table.live(1)}
    moved = {k for k in after if before.get(k) != after[k]}
    assert wrote == len(moved) == 2 and {m for _, m in moved} == {"2026-11", "2026-12"} and len({b for b, _ in moved}) == 1
    nav = {(r.curve, str(r.date)): r.nav for r in table.points().collect()}
    assert nav[3, "2026-12-24"] == pytest.approx(100 * 1.004**120 * 1.5 if (3, "2026-11-01") not in {(p[0], str(p[1])) for p in year([3])} else 100 * 1.004**119 * 1.5)
    assert nav[4, "2026-12-24"] == pytest.approx(100 * 1.005**120)


def test_replays_and_points_that_bring_nothing_change_nothing(table):
    put(table, 0, year(range(6)))
    put(table, 1, [pt("2026-12-30", 0.1, 0.1, curve=2)])
    seen, live = sorted(table.points().collect()), table.live(1)
    assert put(table, 1, [pt("2026-12-30", 0.9, 0.9, curve=2)]) == 0 and put(table, 0, year([9])) == 0
    assert put(table, 2, [pt("2026-12-30", 0.1, 0.1, curve=2, version=5)]) == 0 and table.live(2) == live
    assert sorted(table.points().collect()) == seen
    assert len(table.points(0).collect()) == len(year(range(6)))


def test_a_failed_batch_leaves_the_table_as_it_was(table, monkeypatch):
    put(table, 0, year(range(3)))
    seen = sorted(table.points().collect())
    def lost(self, epoch):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(NavTable, "_partitions", lost)
        with pytest.raises(RuntimeError):
            put(table, 1, [pt("2026-05-05", 0.2, 0.2)])
    assert sorted(table.points().collect()) == seen
    assert put(table, 1, [pt("2026-05-05", 0.2, 0.2)]) > 0 and len(table.points().collect()) == len(seen) + 1


def test_many_batches_equal_one_merge(spark, table):
    import random

    rng = random.Random(2)
    points = [pt(str(dt.date(2026, rng.randrange(1, 5), rng.randrange(1, 28))), rng.choice([None, rng.uniform(-0.05, 0.05)]), rng.choice([None, 0.01]), rng.choice([None, 0.0004]), rng.random() < 0.3, rng.randrange(5), i) for i in range(300)]
    for epoch, k in enumerate(range(0, 300, 75)):
        put(table, epoch, points[k : k + 75])
    df = spark.createDataFrame(points, POINT)
    want = J.upsert_nav(df, spark.createDataFrame([], POINT)).select("curve", "date", *[F.round(c, 9).alias(c) for c in ("nav", "index_nav", "cdi_nav")])
    got = table.points().select("curve", "date", *[F.round(c, 9).alias(c) for c in ("nav", "index_nav", "cdi_nav")])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_stream_of_files(spark, tmp_path):
    source, wrote = str(tmp_path / "in"), []
    first = spark.createDataFrame(year(range(8)), POINT)
    first.coalesce(1).write.parquet(source)
    read = lambda: spark.readStream.schema(POINT).option("maxFilesPerTrigger", 1).parquet(source)
    start(read(), str(tmp_path), 4, lambda e, n: wrote.append(n)).awaitTermination()
    spark.createDataFrame([pt("2026-12-31", 0.1, 0.0, curve=5)], POINT).coalesce(1).write.mode("append").parquet(source)
    start(read(), str(tmp_path), 4, lambda e, n: wrote.append(n)).awaitTermination()
    assert wrote[0] > 12 and wrote[1:] == [1]
    s = rows(NavTable(spark, str(tmp_path / "nav"), 4), 5)
    assert len(s) == 121 and s[-1].nav == pytest.approx(100 * 1.006**120 * 1.1)
