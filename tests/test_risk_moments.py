"""Risk queries: weekly returns are worked out once."""

import datetime as dt

from factorspark.catalog import q_risk
from factorspark.sources.derived import Tables


def test_weekly_returns_are_written_before_they_are_read_twice(spark, tmp_path, monkeypatch):
    day = dt.datetime(2020, 1, 6)
    rows = [(k, 1, s, 1, 2.0, 10.0 + (k * s) % 7, 0.0, 0.0, "N", "O", day + dt.timedelta(days=7 * k)) for k in range(40) for s in (1, 2)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    seen = []
    lookback = q_risk.K.lookback
    monkeypatch.setattr(q_risk.K, "lookback", lambda r, m: (seen.append(r._jdf.queryExecution().optimizedPlan().toString()), lookback(r, m))[1])
    r, _ = q_risk.returns(Tables(spark, str(tmp_path)))
    assert "Window" not in seen[0] and "Aggregate" not in seen[0]
    assert r.count() == 78  # 39 weekly returns of two securities
