"""Cases of the second round: text ids, long lags, free themes, forward as-of on a hot key, values that are no numbers."""
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorspark.operators import portfolio as W
from factorspark.operators import risk as K
from factorspark.operators import selection as L
from factorspark.operators import stats as S
from factorspark.operators import timeseries as ts
from factorspark.operators import xsection as X


def test_ranks_with_text_ids(frame):
    rows = [(1, f"T{i}", float(i // 3)) for i in range(20)] + [(1, None, 5.0), (1, "T99", None), (1, "TX", float("nan"))]
    df = frame("k int, sid string, v double", rows)
    got = {r.sid: r for r in X.quintiles(X.with_first_rank(df, ["k"], "v", "sid"), ["k"], "v", "sid", out="q").collect()}
    order = sorted((v, s) for _, s, v in rows[:20])
    below = {s: sum(v2 < v or (v2 == v and s2 < s) for v2, s2 in order) for v, s in order}
    # the row without an id has value 5 and counts for the values above it
    assert all(got[s]["rank"] == below[s] + (v > 5) + 1 for v, s in order)
    assert got["T99"]["rank"] is None and got["T99"].q is None and got[None].q is None and got["TX"]["rank"] is None
    assert {got[s].q for _, s in order} == {1, 2, 3, 4, 5}


def test_newey_west_with_long_lags(spark):
    rng = np.random.default_rng(4)
    x = np.cumsum(rng.normal(size=300)) * 0.05 + rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "t": range(300), "v": x, "l": 23}))
    d = x - x.mean()
    var = (d @ d + 2 * sum((1 - j / 24) * (d[j:] @ d[:-j]) for j in range(1, 24))) / 300
    expected = x.mean() / np.sqrt(var / 300)
    for lags in (23, F.col("l")):
        assert abs(S.newey_west(df, ["k"], "v", "t", lags).first().t_nw - expected) < 1e-9
    assert abs(S.newey_west(df.withColumn("l", F.lit(500)), ["k"], "v", "t", F.col("l")).first()["mean"] - x.mean()) < 1e-12


def greedy(rows, n):
    """Plain greedy rule under the caps, relaxed step by step."""
    rows = sorted(rows, key=lambda r: (-r["score"], r["sid"]))
    for step in (0, 1, 2):
        got = []
        for r in rows:
            same = lambda f: sum(g[f] == r[f] for g in got)  # noqa: E731, B023
            ok = len(got) < n and not same("company") and same("sector") < 2 and same("theme") < 2
            ok = ok and (step > 1 or r["score"] >= 50) and (step > 0 or r["subsector"] == "" or same("subsector") < 1)
            if ok:
                got.append(r)
        if len(got) == n:
            return [g["sid"] for g in got]
    return [g["sid"] for g in got] + [r["sid"] for r in rows if r not in got][: n - len(got)]


def test_diverse_selection_with_free_themes(spark):
    r = random.Random(6)
    rows = [{"k": k, "sid": i, "company": f"c{r.randrange(12)}", "sector": f"s{r.randrange(2)}", "subsector": r.choice(["", "u", "v"]), "theme": f"t{r.randrange(4)}", "score": float(r.randrange(40, 100))}
            for k in range(40) for i in range(24)]
    got = {}
    for x in L.select_diverse(spark.createDataFrame(rows), ["k"], 5).collect():
        got.setdefault(x.k, {})[x.position] = x.sid
    for k in range(40):
        assert [got[k][p] for p in sorted(got[k])] == greedy([x for x in rows if x["k"] == k], 5)


def test_forward_asof_is_linear_on_a_hot_key(spark):
    left = spark.range(100_000).selectExpr("1 as k", "id * 3 as a")
    right = spark.range(60_000).selectExpr("1 as k", "id * 5 as b", "id as v")
    start = time.perf_counter()
    out = ts.asof(left, right, ["k"], "a", "b", ["v"], forward=True)
    got = out.agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.max(F.col("b_matched") - F.col("a")).alias("far")).first()
    expected = [-(-3 * i // 5) for i in range(100_000) if -(-3 * i // 5) < 60_000]
    assert (got.n, got.s, got.far) == (len(expected), sum(expected), 4) and time.perf_counter() - start < 30
    strict = ts.asof(left.limit(10), right, ["k"], "a", "b", ["v"], strict=True, forward=True).collect()
    assert all(r.b_matched > r.a for r in strict)
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()


def test_rolling_moments_survive_values_that_are_no_numbers(spark):
    x = [float(i % 7) for i in range(60)]
    x[5], x[9] = float("nan"), float("inf")
    df = spark.createDataFrame(pd.DataFrame({"sid": 1, "date": range(60), "x": x}))
    got = ts.rolling_moments(df, "x", ts.Window.partitionBy("sid").orderBy("date"), 10, "m").toPandas().sort_values("date")
    clean = pd.Series(x).replace([np.inf], np.nan)
    assert np.allclose(got["m_mean"], clean.rolling(10, min_periods=1).mean(), equal_nan=True)
    assert np.allclose(got["m_std"].iloc[2:], clean.rolling(10, min_periods=2).std().iloc[2:])


def test_bounds_of_live_weights(spark):
    cases = [[0.9, 0.05, 0.03, 0.02], [0.5, 0.5], [0.25, 0.25, 0.25, 0.25], [0.01] * 5 + [0.95], [], [0.0] * 4, [-1.0, 2.0, 1.0, 1.0, 1.0], [0.3, 0.3, 0.3, 0.05, 0.05]]
    got = [r.w for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ws array<double>").select("i", W.bounded_live(F.col("ws")).alias("w")).orderBy("i").collect()]
    for c, w in zip(cases, got, strict=True):
        assert len(w) == len(c)
        if c:
            assert abs(sum(w) - 1) < 1e-5
        if len(c) >= 4:
            assert all(0.05 - 1e-6 <= x <= 0.30 + 1e-6 for x in w)
            order = np.argsort(c, kind="stable")
            assert all(w[a] <= w[b] + 1e-9 for a, b in zip(order, order[1:], strict=False))
    assert got[1] == [0.5, 0.5] and got[2] == [0.25] * 4 and got[5] == [0.25] * 4


def test_risk_model_takes_text_ids_and_looks_back(spark):
    rng = np.random.default_rng(4)
    days = pd.date_range("2019-01-01", periods=300).date
    rows = pd.concat([pd.DataFrame({"sid": f"T{i}", "date": days, "r": rng.normal(0, .01, 300)}) for i in range(3)])
    market = pd.DataFrame({"date": days[:290], "m": rng.normal(0, .01, 290)})
    r, m = K.lookback(spark.createDataFrame(rows), spark.createDataFrame(market))
    got = sorted(x.date for x in m.collect())
    assert got[0] == days[48] and got[-1] == days[289] and len(got) == 242  # the last 252 dates of either that both have
    f = pd.concat([pd.DataFrame({"date": days, "factor": k, "f": rng.normal(0, .01, 300)}) for k in ("UMD", "MKT", "SEC_A")])
    ortho = K.orthogonalize(spark.createDataFrame(f))
    e = K.exposures(r, ortho).toPandas()
    assert set(e["sid"]) == {"T0", "T1", "T2"} and set(e["factor"]) == {"alpha", "MKT", "UMD", "SEC_A"}
    wide = ortho.toPandas().pivot(index="date", columns="factor", values="f")
    centred = (wide - wide.mean())[["MKT", "UMD", "SEC_A"]].to_numpy()
    products = centred.T @ centred
    assert np.abs(products - np.diag(np.diag(products))).max() < 1e-12  # residuals are orthogonal to the factors before them
    own = rows[(rows["sid"] == "T1") & rows["date"].isin(got)].set_index("date")["r"]
    x = np.column_stack([np.ones(len(own)), wide.loc[own.index, ["MKT", "UMD", "SEC_A"]].to_numpy()])
    beta = np.linalg.lstsq(x, own.to_numpy(), rcond=None)[0]
    assert e[e["sid"] == "T1"].set_index("factor").loc[["alpha", "MKT", "UMD", "SEC_A"], "beta"].to_numpy() == pytest.approx(beta)
    short, none = K.lookback(spark.createDataFrame(rows), spark.createDataFrame(market.head(70)))
    assert short.isEmpty() and none.isEmpty()
