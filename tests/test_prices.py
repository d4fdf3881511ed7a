import datetime as dt

import pytest
from pyspark.sql import functions as F

from factorspark.operators import prices as P
from factorspark.operators import timeseries as ts
from factorspark.sources import readers as R

BARS = "sid string, ticker string, date date, spec string, open double, close double, volume double, trades long, isin string"


def bars(frame, closes, start="2020-01-01", sid="AAAA3", spec="ON NM"):
    days = [(dt.date.fromisoformat(start) + dt.timedelta(i)).isoformat() for i in range(len(closes))]
    return frame(BARS, [(sid, sid, d, spec, float(c), float(c), 1e7, 10, "BR" + sid) for d, c in zip(days, closes)])


def test_fixed_width_line(spark):
    head = "00COTAHIST.2026BOVESPA 20261002".ljust(245)
    line = list(" " * 245)

    def put(a, text):
        line[a - 1:a - 1 + len(text)] = text

    for a, text in ((1, "01"), (3, "20261002"), (11, "02"), (13, "PETR4"), (25, "010"), (28, "PETROBRAS"), (40, "PN      N2"),
                    (57, "0000000004974"), (70, "0000000005135"), (83, "0000000004940"), (96, "0000000005050"), (109, "0000000005117"),
                    (148, "67446"), (153, "000000000056548300"), (171, "000000289368349400"), (211, "0000001"), (231, "BRPETRACNPR6")):
        put(a, text)
    good = "".join(line)
    odd = good[:10] + "96" + good[12:24] + "020" + good[27:]
    etf = good[:10] + "14" + good[12:]
    per_thousand = good[:210] + "0001000" + good[217:]
    df = spark.createDataFrame([(x,) for x in (head, good, odd, etf, per_thousand)], "value string")
    rows = sorted(R.parse_quote_lines(df).collect(), key=lambda r: -r.close)
    assert len(rows) == 2
    r = rows[0]
    assert (r.date, r.ticker, r.spec, r.isin, r.trades) == (dt.date(2026, 10, 2), "PETR4", "PN N2", "BRPETRACNPR6", 67446)
    assert (r.open, r.high, r.low, r.close) == (49.74, 51.35, 49.40, 51.17)
    assert r.volume == pytest.approx(2893683494.0)
    assert rows[1].close == pytest.approx(0.05117)


def test_dividend_and_split(frame):
    px = bars(frame, [20.0, 20, 19, 19, 9.5, 9.5])
    cash = frame("sid string, last_date_prior date, value double", [("AAAA3", "2020-01-02", 1.0)])
    stock = frame("sid string, last_date_prior date, multiplier double", [("AAAA3", "2020-01-04", 2.0)])
    passes = P.split_passes(px, cash, stock)
    out = {r.date.day: r for r in P.adjusted_prices(px, cash, stock).collect()}
    assert out[3].ret_total == pytest.approx(0) and out[3].ret_price == pytest.approx(-0.05)
    assert out[5].ret_price == pytest.approx(0)
    assert out[1].tr_close == pytest.approx(9.5) and out[1].adj_close == pytest.approx(10.0)
    assert P.review_log(passes).count() == 0


def test_jump_without_event(frame):
    px = bars(frame, [30.0, 30, 10.1, 10])
    none_c = frame("sid string, last_date_prior date, value double", [("X", "2020-01-01", 1.0)])
    none_s = frame("sid string, last_date_prior date, multiplier double", [("X", "2020-01-01", 2.0)])
    log = P.review_log(P.split_passes(px, none_c, none_s)).collect()
    assert len(log) == 1 and log[0].accepted and log[0].source == "jump"
    out = {r.date.day: r for r in P.adjusted_prices(px, none_c, none_s).collect()}
    assert out[3].ret_price == pytest.approx(10.1 * 3 / 30 - 1)


def test_rename_chain(frame):
    old, new = bars(frame, [10.0] * 5, sid="OLDX3"), bars(frame, [10.1] * 5, "2020-01-06", "NEWX3")
    px = old.unionByName(new).unionByName(bars(frame, [50.0] * 10, sid="ALIV3"))
    edges = P.detect_renames(px, ts.sessions(px))
    assert [(r.old, r.new) for r in edges.collect()] == [("OLDX3", "NEWX3")]
    ids = {r.ticker: r.sid for r in P.chain_roots(px, edges).collect()}
    assert ids == {"OLDX3": "OLDX3", "NEWX3": "OLDX3", "ALIV3": "ALIV3"}


def test_long_chains_and_cycles(frame):
    chain = [(f"t{i}", f"t{i + 1}") for i in range(9)]
    edges = frame("old string, new string", chain + [("a", "b"), ("b", "a")])
    tickers = frame("ticker string", [(f"t{i}",) for i in range(10)] + [("a",), ("b",), ("z",)])
    ids = {r.ticker: r.sid for r in P.chain_roots(tickers, edges).collect()}
    assert all(ids[f"t{i}"] == "t0" for i in range(10))
    assert (ids["a"], ids["b"], ids["z"]) == ("a", "b", "z")


def test_universe_ignores_the_future(spark, frame):
    days = [r.d for r in spark.sql("select explode(sequence(date'2019-01-01', date'2020-03-01', interval 1 day)) d").collect()]

    def rows(sid, spec, close, volume, step=1):
        return [(sid, sid, d.isoformat(), spec, close, close, volume, 100, sid) for i, d in enumerate(days) if i % step == 0 and d < dt.date(2020, 1, 1)]

    data = rows("AAAA3", "ON", 10.0, 3e6) + rows("BBBB4", "PN N1", 10.0, 1e6) + rows("HALF3", "ON", 10.0, 9e6, 2) + rows("CENT3", "ON", 0.5, 9e6) + rows("DRNX34", "DRN", 10.0, 9e9)
    data += [("AAAA3", "AAAA3", "2020-01-01", "ON", 10.0, 10.0, 1.0, 1, "A"), ("ZZZZ3", "ZZZZ3", "2020-02-03", "ON", 10.0, 10.0, 1e12, 9, "Z")]
    px = frame(BARS, data)
    u = P.universe_history(px, ts.sessions(px)).filter("rebalance_date = '2020-01-01'").orderBy("rank").collect()
    assert [r.sid for r in u] == ["AAAA3", "BBBB4"]
    # adding later bars never changes an earlier rebalance
    more = px.unionByName(frame(BARS, [("NEWW3", "NEWW3", "2020-03-02", "ON", 1.0, 1.0, 1e15, 9, "N")]))
    again = P.universe_history(more, ts.sessions(more)).filter("rebalance_date = '2020-01-01'").orderBy("rank").collect()
    assert [(r.sid, r.in_index) for r in again] == [(r.sid, r.in_index) for r in u]


def test_asof_forward_and_strict(frame):
    left = frame("k string, t date", [("a", "2020-01-05"), ("a", "2020-01-10"), ("b", "2020-01-01")])
    right = frame("k string, d date, v int", [("a", "2020-01-05", 1), ("a", "2020-01-09", 2), ("a", "2020-01-12", 3)])

    def run(**kw):
        return [(r.k, r.t.day, r.v) for r in ts.asof(left, right, ["k"], "t", "d", ["v"], **kw).orderBy("k", "t").collect()]

    assert run() == [("a", 5, 1), ("a", 10, 2), ("b", 1, None)]
    assert run(strict=True) == [("a", 5, None), ("a", 10, 2), ("b", 1, None)]
    assert run(forward=True) == [("a", 5, 1), ("a", 10, 3), ("b", 1, None)]
    assert run(forward=True, strict=True) == [("a", 5, 2), ("a", 10, 3), ("b", 1, None)]


def test_share_type_and_marker(frame):
    df = frame("spec string", [("ON* NM",), ("PN EB N1",), ("UNT  EDJ",), ("ON",)])
    assert [(r.t, r.m) for r in df.select(P.share_type(F.col("spec")).alias("t"), P.ex_marker(F.col("spec")).alias("m")).collect()] == [
        ("ON", ""), ("PN", "EB"), ("UNT", "EDJ"), ("ON", "")]
