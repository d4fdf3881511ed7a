"""The panel by month, over tables built here: the whole panel, from the bars and documents that a member can need."""

import datetime as dt
import itertools

from factorspark.catalog import q_panel as Q
from factorspark.catalog.registry import REGISTRY
from factorspark.sources.derived import Tables

DAYS = [d for k in range(590) if (d := dt.datetime(2019, 1, 1) + dt.timedelta(days=k)).weekday() < 5]


def price(k, s):
    return 30.0 + s + (k * (s + 3)) % 11


def tables(spark, root):
    """Three securities with a price on most of 422 days; 9 is of a kind that is never a member. Nobody's issuer is customer 500; one order has none."""
    prints = [(k * 10 + s, 1, s, 1, 2.0, 2 * price(k, s), 0.01 if k % 40 == s else 0.05, 0.04, "R" if k % 40 == s else "N", "O", d) for k, d in enumerate(DAYS) for s in (2, 3, 9) if (k + s) % 17]
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    put("lineitem", prints, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp")
    orders = [(k, c, 1000.0 * k + 150_000, dt.datetime(2019 + k // 12, k % 12 + 1, 5), "1-URGENT" if c == 2 else "2-HIGH") for k in range(18) for c in (2, 7, 500, None)]
    put("orders", [(i, *o[1:]) for i, o in enumerate(orders)], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string")
    put("supplier", [(s, f"S{s}", 0, 40.0 * s) for s in (2, 3, 9)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    put("nation", [(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int")
    put("region", [(0, "R")], "r_regionkey int, r_name string")
    return str(root)


def test_months_are_built_from_bars_and_documents_of_members(spark, tmp_path, monkeypatch):
    root = tables(spark, tmp_path / "in")
    seen, update = [], Q.T.PanelTable.update
    monkeypatch.setattr(Q, "shared_dir", lambda _, label: str(tmp_path / label))
    monkeypatch.setattr(Q.T.PanelTable, "update", lambda self, index, months, members, docs, *a, **k: (seen.append(docs), update(self, index, months, members, docs, *a, **k))[1])
    got = {(r.t, r.sid): r for r in REGISTRY["panel_by_month"].build(Tables(spark, root)).select("t", "sid", "px", "VOL", "fwd", "doc_ref").collect()}
    ends = [d for d, after in itertools.pairwise(DAYS) if d.month != after.month and DAYS.index(d) >= 262]
    assert got.keys() == {(d.date(), s) for d in ends for s in (2, 3)} and len(ends) >= 6
    for (t, s), r in got.items():
        last = max(k for k, d in enumerate(DAYS) if d.date() < t and (k + s) % 17)
        assert r.px == price(last, s) and r.VOL > 0 and r.fwd is not None
    assert any(r.doc_ref is not None for r in got.values())
    assert {r.sid for r in spark.read.parquet(str(tmp_path / "bars")).select("sid").distinct().collect()} == {2, 3}
    assert len(seen) == 2  # first without the last year, then with it
    assert {r.issuer for d in seen for r in d.select("issuer").distinct().collect()} <= {2, 3, 7, 10}
    assert all("Aggregate" not in d._jdf.queryExecution().executedPlan().toString() for d in seen)  # versions are combined once for all who read them
