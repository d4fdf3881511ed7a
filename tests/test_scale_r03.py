"""Steps whose work must grow with the input only; every table is built here."""

import contextlib
import io
import itertools
import math
from hashlib import md5

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorspark.operators import evaluate as E
from factorspark.operators import prices as P
from factorspark.operators import stats as T
from factorspark.operators import timeseries as ts


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_bootstrap_draws_are_no_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, t, float(rng.normal(0.01, 0.05)), float(rng.normal(0, 0.05))) for k, n in ((1, 40), (2, 12), (3, 1)) for t in range(n)]
    rows += [(4, t, 0.1, 0.1 + t) for t in range(9)] + [(None, 1, 0.1, 0.2), (1, 99, None, 0.2)]
    df = spark.createDataFrame(rows, "k long, t long, a double, b double")
    found = T.block_bootstrap_sharpe_diff(df, ["k"], "a", "b", "t", reps=50)
    assert "Generate" not in plan(found)
    got = {r.k: r for r in found.collect()}
    assert set(got) == {1, 2, 3, 4} and all(r.reps == 50 for r in got.values())
    assert got[3].lo is None and got[4].lo is None  # one period; a series without spread
    for k in (1, 2):
        x = np.array([(r[2], r[3]) for r in rows if r[0] == k and r[2] is not None])
        m, diffs = len(x), []
        for rep in range(1, 51):
            start = [int(md5(f"0|{k}|{rep}|{b}".encode()).hexdigest()[:15], 16) % m for b in range(m // 6 + 1)]
            d = x[[(s + j) % m for b, s in enumerate(start) for j in range(6) if b * 6 + j < m]]
            sr = d.mean(axis=0) / d.std(axis=0, ddof=1) * math.sqrt(12)
            diffs.append(sr[0] - sr[1])
        assert (got[k].lo, got[k].hi) == pytest.approx(tuple(np.percentile(diffs, (2.5, 97.5))), abs=1e-9)


def listings(spark, rows):
    """Bars of tickers, given as (ticker, days, price)."""
    days = pd.bdate_range("2020-01-01", periods=8)
    cells = [(t, days[i].date(), "ON NM", p, p, 5e6) for t, span, p in rows for i in span]
    return spark.createDataFrame(cells, "ticker string, date date, spec string, open double, close double, volume double")


def test_rename_candidates_are_counted_not_kept(spark):
    many = [(f"O{i:02d}", range(4), 10.0) for i in range(20)] + [(f"N{i:02d}", range(4, 8), 10.0) for i in range(20)]
    bars = listings(spark, [*many, ("OLD", range(4), 100.0), ("NEW", range(4, 8), 101.0)])
    edges = P.detect_renames(bars, ts.sessions(bars))
    assert "first(struct" not in plan(edges)
    assert [(r.old, r.new, r.price_gap) for r in edges.collect()] == [("OLD", "NEW", 0.01)]


def test_sleeves_need_only_names_with_a_return(spark):
    names = spark.createDataFrame([("a", 1, 1.0, 0.1), ("a", 2, 3.0, None), ("b", 1, 2.0, None)], "k string, sid int, w double, ret double")
    sleeves = names.groupBy("k").agg(F.sum("w").alias("_w"), F.count("*").alias("_all"))
    whole = {tuple(r) for r in E.weighted_return(names, ["k"]).collect()}
    assert {tuple(r) for r in E.weighted_return(names.filter("ret is not null"), ["k"], sleeves).collect()} == whole


def test_attribution_keeps_its_three_levels(spark):
    h = spark.createDataFrame([(1, "x", 1, 0.5, 0.1), (1, "x", 2, 0.5, None)], "rec int, sector string, sid int, w double, ret double")
    out = E.attribution(h, ["rec"])
    assert sorted(r.level for r in out.collect()) == ["name", "name", "sector", "total"]


def test_a_return_travels_once_for_all_groups(spark, tmp_path, monkeypatch):
    """Groups whose baskets change on other days: weights in force by plain loops; returns aren't repeated for each group."""
    import datetime as dt

    from factorspark.catalog import q_evaluate as Q
    from factorspark.sources.derived import Tables

    days = [dt.datetime(2020, 1, 1) + dt.timedelta(days=k) for k in range(90)]
    li = [(k, 1, s, 1, 2.0, 2 * (10.0 + (k * (s + 2)) % 7), 0.0, 0.03, "N", "O", d) for k, d in enumerate(days) for s in (1, 2, 3)]
    # customers 0 and 5 are one group, 1 another; customer 1 has no basket in February, none has a security 3 in March
    buys = [(1000, 0, "2020-01-05", 1, 10.0), (1001, 5, "2020-01-07", 1, 30.0), (1002, 0, "2020-02-03", 2, 7.0), (1003, 1, "2020-01-09", 2, 4.0),
            (1004, 1, "2020-03-02", 1, 5.0), (1005, 5, "2020-02-20", 3, 3.0), (1006, 1, "2020-01-20", 3, 12.0)]
    li += [(o, 1, s, 1, 1.0, v, 0.0, 0.03, "N", "O", days[0] - dt.timedelta(days=900)) for o, _, _, s, v in buys]
    spark.createDataFrame(li, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                          "l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(o, c, dt.datetime.fromisoformat(d)) for o, c, d, _, _ in buys]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    seen, whole = [], E.weighted_return
    monkeypatch.setattr(Q.E, "weighted_return", lambda rows, *a: (seen.append(rows), whole(rows, *a))[1])
    got = {(r.grp, r.date): (r.rec_date, r.port_ret, r.n_missing) for r in Q.nav_points(Tables(spark, str(tmp_path))).collect()}
    groups = {}
    for _, c, d, s, v in buys:
        groups.setdefault(c % 5, {}).setdefault(dt.date.fromisoformat(d[:8] + "01"), {}).setdefault(s, []).append(v)
    px = {(s, d.date()): 10.0 + (k * (s + 2)) % 7 for k, d in enumerate(days) for s in (1, 2, 3)}
    expected = 0
    for g, baskets in groups.items():
        for a, b in itertools.pairwise(days):
            held = max(d for d in baskets if d <= b.date())
            w = {s: sum(v) for s, v in baskets[held].items()}
            ret = sum(x * math.tanh(px[s, b.date()] / px[s, a.date()] - 1) / 20 for s, x in w.items()) / sum(w.values())
            assert got[g, b.date()] == (held, pytest.approx(ret, abs=1e-12), 0)
            expected += 1
    assert sum(v[1] is not None for v in got.values()) == expected + len(groups)  # the first day's, against the session of the purchases
    # days with one month in force for both groups are met once
    pairs = {(b.date(), max(d for d in baskets if d <= b.date())) for baskets in groups.values() for b in days[1:]}
    text = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert len(pairs) < expected and "Join Inner, ((rec_date" in text


def test_bars_meet_rebalances_without_an_exchange_by_period(spark):
    """Expanded bars and their totals stay where the securities are, even if Spark may not choose a broadcast itself."""
    days = pd.bdate_range("2020-01-01", "2021-02-01")
    rows = [(s, f"T{s}", f"I{s}", d.date(), "ON NM", 2, 100.0 * s, 10.0) for s in (1, 2, 3) for i, d in enumerate(days) if s < 3 or i % 10 == 0]
    rows += [(4, "T4", "I4", days[5].date(), "DRN", 9, 1e9, 10.0), (5, "T5", "I5", None, "ON", 9, 1e9, 10.0)]
    bars = spark.createDataFrame(rows, "sid long, ticker string, isin string, date date, spec string, trades long, volume double, close double")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = P.universe_history(bars, ts.sessions(bars.filter("date is not null")), size=2, min_presence=0.5)
        text = plan(found)
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "hashpartitioning(period" not in text and "hashpartitioning(rebalance_date#" in text  # the ranking's, of few rows
    assert "SortMergeJoin" not in text
    reb = [d.date() for d in (days[days.month == 5][0], days[days.month == 9][0], days[days.year == 2021][0])]
    want = set()
    for r in reb:
        n = sum(0 < (r - d.date()).days <= 365 for d in days)
        want |= {(r, s, 3 - s, n, 2 * n, round(100.0 * s * n, 2)) for s in (1, 2)}
    assert {(r.rebalance_date, r.sid, r["rank"], r.sessions, r.trades, r.volume) for r in got} == want


def test_versions_of_other_issuers_are_left_out_before_they_are_sorted(spark, tmp_path):
    from factorspark.catalog import q_panel as Q
    from factorspark.sources.derived import Tables

    rows = [(1, 7, 100.0, "1996-02-03"), (95, 7, 200.0, "1996-02-20"), (3, 8, 300.0, "1996-02-04"), (4, None, 400.0, "1996-02-05"), (5, 7, 500.0, "1996-03-05")]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, d string").withColumn("o_orderdate", F.to_timestamp("d")).drop("d")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    t = Tables(spark, str(tmp_path))
    issuers = spark.createDataFrame([(7,), (None,), (9,)], "_issuer long")
    some = Q.documents(t, issuers)
    lines = plan(some).splitlines()
    semi, last_aggregate = (max(i for i, line in enumerate(lines) if word in line) for word in ("LeftSemi", "Aggregate(key=[issuer"))
    assert semi > last_aggregate  # below, so before
    whole = [tuple(r) for r in Q.documents(t).collect()]
    assert sorted(map(tuple, some.collect()), key=str) == sorted((r for r in whole if r[0] != 8), key=str) and len(whole) == 4
