"""What is exchanged: kept bars have the columns a query reads, runs of a walk-forward stay where they are."""

import datetime as dt

from factorspark.operators import evaluate as E
from factorspark.sources.derived import Tables


def prints(spark, root):
    day = dt.datetime(2024, 1, 2)
    rows = [(k, 1, s, 1, 2.0, 10.0 * k, 0.0, 0.0, "N", "O", day + dt.timedelta(days=k % 2)) for k in range(1, 7) for s in (1, 2)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, names).write.parquet(f"{root}/lineitem.parquet")
    return Tables(spark, str(root))


def test_kept_bars_have_the_columns_that_are_read(spark, tmp_path):
    t = prints(spark, tmp_path)
    whole = {(r.sid, r.date): (r.close, r.volume) for r in t.bars.collect()}
    assert t.keep_bars("close").bars.columns == ["sid", "date", "close"]
    assert t.sbars.columns == ["date", "sid", "close", "sno"]
    assert {(r.sid, r.date): r.close for r in t.bars.collect()} == {k: v[0] for k, v in whole.items()}
    first = t.bars
    assert t.keep_bars("close").bars is first  # kept once
    assert t.keep_bars("volume").bars.columns == ["sid", "date", "close", "volume"]
    assert {(r.sid, r.date): (r.close, r.volume) for r in t.bars.collect()} == whole


def test_walk_forward_does_not_exchange_runs_for_the_levels(spark):
    entries = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "rec long, entry_sno int")
    held = spark.createDataFrame([(1, 7, 1.0), (2, 7, 1.0), (3, 7, 1.0)], "rec long, sid long, w double")
    bars = spark.createDataFrame([(7, s, float(s)) for s in range(1, 9)], "sid long, sno int, close double")
    sessions = bars.select("sno")
    index = bars.select("sno", "close")
    wf = E.walk_forward(entries, held, bars, sessions, index, index.selectExpr("sno", "0.5D as cdi"), horizons=(5,))
    plan = wf._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(exit_sno" not in plan and "hashpartitioning(entry_sno" not in plan
    got = {r.rec: (r.port, r.index_ret, r.n_missing) for r in wf.collect()}
    assert got == {1: (5.0, 5.0, 0), 2: (2.5, 2.5, 0)}
