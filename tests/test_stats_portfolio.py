import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorspark.functions import normal as N
from factorspark.functions import scalars as S
from factorspark.operators import live as V
from factorspark.operators import portfolio as W
from factorspark.operators import risk as K
from factorspark.operators import stats as T
from factorspark.streaming import jobs as J


def test_normal(spark):
    df = spark.range(-60, 61).select((F.col("id") / 10).alias("x"))
    for x, p, z in df.select("x", N.norm_cdf(F.col("x")), N.norm_ppf(N.norm_cdf(F.col("x")))).collect():
        assert p == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), rel=1e-10)
        if abs(x) < 5:
            assert z == pytest.approx(x, abs=1e-6)


def test_student_t(frame):
    df = frame("t double, v double", [(2.0, 10.0), (0.0, 3.0), (-1.5, 4.4), (12.706204736, 1.0)])
    got = [r[0] for r in df.select(N.student_t_p("t", "v")).collect()]
    assert got == pytest.approx([0.0733880, 1.0, 0.2019, 0.05], abs=2e-3)
    assert got[0] == pytest.approx(0.07338803, abs=1e-7) and got[3] == pytest.approx(0.05, abs=1e-8)


def test_newey_west_lag_zero_is_the_plain_t(frame):
    x = [0.3, -0.1, 0.5, 0.2, 0.4, -0.2]
    df = frame("k int, i int, x double", [(1, i, v) for i, v in enumerate(x)])
    assert T.newey_west(df, ["k"], "x", "i", 0).first().t_nw == pytest.approx(np.mean(x) / (np.std(x) / math.sqrt(6)))
    e = np.array(x) - np.mean(x)
    var = (e @ e + 2 * 0.5 * (e[1:] @ e[:-1])) / 6
    assert T.newey_west(df, ["k"], "x", "i", 1).first().t_nw == pytest.approx(np.mean(x) / math.sqrt(var / 6))


def test_benjamini_hochberg(frame):
    df = frame("k int, f string, p double", [(1, "a", 0.001), (1, "b", 0.01), (1, "c", 0.03), (1, "d", 0.5)])
    assert [r.reject for r in T.benjamini_hochberg(df, ["k"], "p", "f").orderBy("f").collect()] == [True, True, True, False]


def test_rank_ic_extremes(spark):
    pdf = pd.DataFrame({"k": [1] * 30 + [2] * 30, "sid": list(range(30)) * 2, "s": list(range(30)) * 2, "f": list(range(30)) + list(range(30, 0, -1))}).astype(float)
    assert {r.k: r.ic for r in T.rank_ic(spark.createDataFrame(pdf), ["k"], "s", "f").collect()} == {1.0: 1.0, 2.0: -1.0}


def test_unbiased_shape(spark):
    x = pd.Series(np.random.default_rng(3).exponential(size=50))
    skew, kurt = T.unbiased_shape()
    r = T.series_moments(spark.createDataFrame(pd.DataFrame({"k": 1, "x": x})), ["k"], "x").select(skew, kurt).first()
    assert r[0] == pytest.approx(x.skew()) and r[1] == pytest.approx(x.kurt() + 3)


def test_friction_and_scalars(frame):
    df = frame("adv double", [(1e9,), (50e6,), (12.5e6,), (1e3,), (None,)])
    assert [r[0] for r in df.select(S.friction(F.col("adv"))).collect()] == pytest.approx([.0013, .0013, .0026, .0065, .0013])
    e = frame("l string, f double", [("DESDOBRAMENTO", 100.0), ("BONIFICACAO", 10.0), ("GRUPAMENTO", 0.1), ("INCORPORACAO", 1.0)])
    assert [r[0] for r in e.select(S.share_multiplier(F.col("l"), F.col("f"))).collect()] == [2.0, 1.1, 0.1, None]
    y = frame("y int", [(2024,), (2025,), (2026,)])
    assert [str(r[0]) for r in y.select(S.easter(F.col("y"))).collect()] == ["2024-03-31", "2025-04-20", "2026-04-05"]
    n = frame("s string", [("1.234,56",), ("x",), ("7",)])
    assert [r[0] for r in n.select(S.br_number(F.col("s"))).collect()] == [1234.56, None, 7.0]


def test_weight_bounds(frame):
    vols = [(1, i, v) for i, v in enumerate([.05, .2, .3, .4, .6])] + [(2, 0, .2), (2, 1, .3)] + [(3, i, None) for i in range(5)] + [(4, i, v) for i, v in enumerate([.01, .9, .9, .9, None])]
    df = frame("p int, sid int, vol double", vols)
    for variant in ("live", "study"):
        w = W.inverse_vol_weights(df.filter("p in (1, 4)"), ["p"], "vol", variant).toPandas()
        assert w.groupby("p")["w"].sum().to_numpy() == pytest.approx([1, 1], abs=1e-5)
        assert w["w"].max() <= 0.30 + 1e-3 and w["w"].min() >= 0.05 - 1e-3
    live = W.inverse_vol_weights(df, ["p"], "vol").toPandas().set_index(["p", "sid"])["w"]
    assert live[2].tolist() == [0.5, 0.5] and live[3].tolist() == pytest.approx([0.2] * 5)


def test_cost_only_on_turnover(frame):
    rows = [(t, f"s{i}", 0.05, 0.0) for t in ("2020-01-31", "2020-02-29", "2020-03-31") for i in range(20)]
    w = frame("t date, sid string, w double, fwd double", rows).withColumn("leg", F.lit("L"))
    costs = w.select("t", "sid").withColumn("friction", F.lit(0.0013))
    out = W.rebalanced_returns(w, costs, ["leg"]).orderBy("t").collect()
    assert [r.net for r in out] == pytest.approx([-0.0013, 0, 0]) and [r.turnover for r in out] == pytest.approx([0.5, 0, 0])


def test_allocation_path(frame):
    rows = [(i, "2020-01-01", s, (0.10 if (i == 5 and s == "equities_br") else 0.0) if i else None) for i in range(60) for s in ("equities_br", "cdi")]
    r = frame("i int, date date, sleeve string, ret double", rows).withColumn("v", F.lit(1))
    tg = frame("i int, sleeve string, w double", [(0, "equities_br", 1.0), (21, "cdi", 1.0), (42, "cdi", 1.0)]).withColumn("v", F.lit(1))
    nav = {x.i: x.nav for x in W.drift_nav(r, tg, ["v"]).collect()}
    assert nav[0] == 100 and nav[1] == pytest.approx(99.9)
    assert nav[21] == pytest.approx(100 * (1 - .001) * 1.10) and nav[22] == pytest.approx(nav[21] * (1 - .002)) and nav[59] == pytest.approx(nav[22])


def test_spacing_uses_the_last_kept(frame):
    df = frame("rec int, date date", [(1, d) for d in ("2020-01-01", "2020-01-03", "2020-01-04", "2020-01-05", "2020-01-07", "2020-01-08")])
    assert [r.date.day for r in V.keep_spaced(df, "rec", "date").orderBy("date").collect()] == [1, 4, 7]


def test_stale_prices(frame):
    rows = [("ok", i, 10.0 + i) for i in range(1, 31)] + [("frozen", i, 9.0) for i in range(1, 31)] + [("lag", i, 5.0 + i) for i in range(1, 25)] + [("cheap", i, 1.5 if i > 22 else 1.0) for i in range(1, 31)]
    df = frame("sid string, sno int, close double", rows)
    out = {r.sid: r.reason for r in V.stale_prices(df, df.agg(F.max("sno").alias("last_sno"))).collect()}
    assert out == {"frozen": "frozen", "lag": "lag"}


def test_nav_upsert_rechains(frame):
    schema = "curve int, date date, version long, provisional boolean, port_ret double, index_ret double, cdi_ret double"
    old = frame(schema, [(1, "2020-01-01", 1, False, 0.01, 0.0, 0.001), (1, "2020-01-02", 2, True, None, None, None), (1, "2020-01-04", 2, False, 0.5, 0.0, 0.0)])
    new = frame(schema, [(1, "2020-01-02", 3, False, 0.02, 0.01, None), (1, "2020-01-03", 4, False, 0.0, 0.0, 0.002), (1, "2020-01-01", 5, True, None, None, None)])
    trading = frame("date date", [("2020-01-01",), ("2020-01-02",), ("2020-01-03",)])
    out = J.upsert_nav(new, old, trading, "2020-01-01").orderBy("date").collect()
    assert [r.date.day for r in out] == [1, 2, 3]
    assert [r.nav for r in out] == pytest.approx([101, 101 * 1.02, 101 * 1.02])
    assert [r.cdi_nav for r in out] == pytest.approx([100.1, 100.1 * 1.001, 100.1 * 1.001 * 1.002])


def test_risk_model_recovers_betas(spark):
    rng = np.random.default_rng(0)
    days = pd.date_range("2020-01-01", periods=200).date
    f = pd.DataFrame({"MKT": rng.normal(0, .01, 200), "SMB": rng.normal(0, .005, 200)}, index=days)
    long = f.stack().reset_index()
    long.columns = ["date", "factor", "f"]
    ortho = K.orthogonalize(spark.createDataFrame(long))
    wide = ortho.toPandas().pivot(index="date", columns="factor", values="f")
    assert abs(wide["MKT"] @ (wide["SMB"] - wide["SMB"].mean())) < 1e-10
    y = pd.concat([pd.DataFrame({"sid": s, "date": days, "r": b * wide["MKT"].to_numpy() + 2 * wide["SMB"].to_numpy()}) for s, b in ((1, 0.5), (2, 1.5))])
    e = K.exposures(spark.createDataFrame(y), ortho)
    beta = {(r.sid, r.factor): r.beta for r in e.collect()}
    assert beta[1, "MKT"] == pytest.approx(0.5) and beta[2, "MKT"] == pytest.approx(1.5) and beta[1, "SMB"] == pytest.approx(2)
    w = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5)], "p int, sid long, w double")
    d = K.risk_decomposition(w, e, K.factor_cov(ortho), ["p"]).toPandas()
    assert d["contribution"].sum() == pytest.approx(d["factor_vol"].iloc[0] ** 2)


def test_bootstrap_is_deterministic(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "t": range(60), "a": rng.normal(.02, .05, 60), "b": rng.normal(0, .05, 60)}))
    one, two = (T.block_bootstrap_sharpe_diff(df, ["k"], "a", "b", "t", reps=100).first() for _ in range(2))
    assert one == two and one.lo < one.hi and one.reps == 100
