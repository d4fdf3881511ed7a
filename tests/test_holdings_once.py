"""Holdings of baskets: what depends on security and day is looked up once, holdings and attribution levels travel once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factorspark.catalog import q_evaluate as Q
from factorspark.operators import evaluate as E
from factorspark.sources.derived import Tables

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def test_a_security_and_day_is_looked_up_once_for_all_baskets(spark, tmp_path, monkeypatch):
    day = lambda m, d: dt.datetime(2020, m, d)
    # closes of 1 and 2: 10 and 20 before March, 12 and none since; a dividend of 1 in March, one of 3 in June; 34 has no price two months on, nobody's price is known
    prints = [(1, 1, 1, 1, 2.0, 20.0, 0.5, 0.0, "N", "O", day(2, 3)), (2, 1, 2, 1, 2.0, 40.0, 0.5, 0.0, "N", "O", day(2, 4)), (3, 1, 1, 1, 2.0, 24.0, 0.01, 10 / 12, "R", "O", day(3, 9)),
              (4, 1, 1, 1, 2.0, 24.0, 0.01, 30 / 12, "R", "F", day(6, 9)), (5, 1, 34, 1, 2.0, 8.0, 0.5, 0.0, "N", "O", day(2, 3))]
    buys = [(10, 100, 1, 30.0), (11, 101, 1, 50.0), (12, 102, 1, 10.0), (12, 102, 2, 30.0), (13, 103, 34, 5.0), (14, 104, None, 5.0), (14, 104, 1, 15.0)]  # order, customer, security, value; all in March
    old = dt.datetime(1990, 1, 1)
    spark.createDataFrame([*prints, *[(o, 1, s, 1, 0.0, v, 0.5, 0.0, "N", "O", old) for o, _, s, v in buys]], LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, c, day(3, 5)) for o, c in sorted({b[:2] for b in buys})], "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(s, f"S{s}", s % 2, 1.0) for s in (1, 2, 34)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, "N0", 0), (1, "N1", 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "EVEN"), (1, "ODD")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    seen, look = [], E.price_at
    monkeypatch.setattr(Q.E, "price_at", lambda rows, *a, **k: (seen.append(rows.count()), look(rows, *a, **k))[1])
    t = Tables(spark, str(tmp_path))
    got = {(r.rec, r.sid): (r.w, r.entry, r.price, r.dividends, r.jcp) for r in Q.holdings(t).collect()}
    assert seen == [4, 4]  # 1, 2, 34 and nobody, in March, for seven holdings
    assert got == {(100, 1): (1.0, 10.0, 12.0, pytest.approx(1.0), pytest.approx(1.0)), (101, 1): (1.0, 10.0, 12.0, pytest.approx(1.0), pytest.approx(1.0)),
                   (102, 1): (0.25, 10.0, 12.0, pytest.approx(1.0), pytest.approx(1.0)), (102, 2): (0.75, 20.0, 20.0, 0.0, 0.0), (103, 34): (1.0, 4.0, None, 0.0, 0.0),
                   (104, None): (0.25, None, None, 0.0, 0.0), (104, 1): (0.75, 10.0, 12.0, pytest.approx(1.0), pytest.approx(1.0))}
    rows = {(r.rec, r.level, r.sector, r.sid): (round(r.weight, 9), round(r.contribution, 9), r.n) for r in E.attribution(Q.with_returns(t), Q.KEYS).collect()}
    assert rows[102, "total", None, None] == (1.0, 0.075, 2) and rows[102, "sector", "ODD", None] == (0.25, 0.075, 1) and rows[102, "name", "EVEN", 2] == (0.75, 0.0, 1)
    assert rows[103, "total", None, None] == (1.0, 0.0, 1) and rows[104, "total", None, None] == (0.75, 0.225, 1) and len(rows) == 3 + 3 + 5 + 3 + 3


def test_attribution_exchanges_a_holding_once_and_does_not_repeat_it_for_its_levels(spark):
    h = [(1, "x", 1, 0.25, 0.1), (1, "x", 2, 0.25, None), (1, "y", 3, 0.25, -0.2), (1, None, 4, 0.125, 0.4), (1, "x", 1, 0.125, 0.1), (2, "y", None, 1.0, 0.3), (None, "x", 1, None, 0.5)]
    df = spark.createDataFrame(h, "rec int, sector string, sid int, w double, ret double")
    out = E.attribution(df, ["rec"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "hashpartitioning(rec" in plan and plan.count("Exchange") == plan.count("hashpartitioning(rec#")
    want = {}
    for rec, sector, sid, w, ret in h:
        for key in ((rec, "name", sector, sid), (rec, "sector", sector, None), (rec, "total", None, None)):
            want.setdefault(key, []).append((w, None if w is None else w * (ret or 0.0)))
    total = lambda xs: pytest.approx(sum(xs)) if all(x is not None for x in xs) else None
    got = out.collect()
    assert len(got) == len(want) == 6 + 5 + 3
    assert {(r.rec, r.level, r.sector, r.sid): (r.weight, r.contribution, r.n) for r in got} == {k: (total([w for w, _ in v]), total([c for _, c in v]), len(v)) for k, v in want.items()}
    assert all(r.ret == pytest.approx(r.contribution / r.weight) for r in got if r.weight) and out.filter(F.col("ret").isNull()).count() == 0
