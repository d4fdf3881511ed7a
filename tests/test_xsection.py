import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorspark.operators import selection as L
from factorspark.operators import xsection as X


def test_live_sector_rule(frame):
    rows = [(1, f"T{i}", "big", float(i)) for i in range(10)] + [(1, f"P{i}", "mid", float(i)) for i in range(5)] + [(1, f"G{i}", "two", float(i)) for i in range(2)]
    out = {r.sid: r for r in X.normalize_adaptive(frame("k int, sid string, sector string, v double", rows), ["k"], "sector", "v").collect()}
    assert out["T9"].score > 70 and out["T0"].score < 30 and 40 < out["T4"].score < 60 and 40 < out["T5"].score < 60
    assert all(0 <= r.score <= 100 for r in out.values())
    assert (out["T0"].method, out["P0"].method, out["G0"].method) == ("zscore_sectoral", "percentile_sectoral", "zscore_global")
    assert out["P4"].score == 100 and out["P0"].score == 20


def test_ranks_of_a_hot_group(spark):
    """Most rows share one key and many share one value; ranks still equal those of pandas."""
    rng = np.random.default_rng(1)
    v = np.concatenate([np.full(3000, 7.0), rng.normal(100, 1e-3, 3000), rng.standard_cauchy(3000), -rng.exponential(5, 500)])
    pdf = pd.DataFrame({"k": ["hot"] * 9000 + ["cold"] * 500, "sid": range(9500), "v": v})
    df = spark.createDataFrame(pdf).repartition(8)
    got = X.with_first_rank(X.with_average_rank(df, ["k"], "v", "avg"), ["k"], "v", "sid", "first").toPandas().sort_values("sid")
    g = pdf.groupby("k")["v"]
    assert np.allclose(got["avg"], g.rank())
    assert np.array_equal(got["first"], g.rank(method="first"))
    q = X.quantiles(df, ["k"], "v", {"a": 0.05, "b": 0.5}).toPandas().set_index("k")
    assert np.allclose(q["a"], g.quantile(0.05).reindex(q.index)) and np.allclose(q["b"], g.quantile(0.5).reindex(q.index))


def test_winsor(frame):
    df = frame("k int, sid int, v double", [(1, i, float(x)) for i, x in enumerate([1, 2, 3, 4, 5, 1000])])
    out = [r.w for r in X.mad_winsor(df, ["k"], "v", 5.0).orderBy("sid").collect()]
    assert out[:5] == [1, 2, 3, 4, 5] and out[5] < 20


def test_quintiles_match_qcut(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": 1, "sid": range(47), "v": rng.normal(size=47).round(1)})
    got = X.quintiles(spark.createDataFrame(pdf), ["k"], "v", "sid").toPandas().sort_values("sid")["bucket"].to_numpy()
    assert np.array_equal(got, pd.qcut(pdf["v"].rank(method="first"), 5, labels=False).to_numpy() + 1)
    few = X.quintiles(spark.createDataFrame(pdf.head(14)), ["k"], "v", "sid").filter("bucket is not null").count()
    assert few == 0


def greedy(rows, n=5):
    """Plain statement of the selection rule."""
    def fill(floor, sub):
        sel = []
        for r in rows:
            if len(sel) == n:
                break
            if floor and r["score"] < 50 or any(s["company"] == r["company"] for s in sel):
                continue
            if sum(s["sector"] == r["sector"] for s in sel) >= 2 or sum(s["theme"] == r["theme"] for s in sel) >= 2:
                continue
            if sub and r["subsector"] and any(s["subsector"] == r["subsector"] for s in sel):
                continue
            sel.append(r)
        return sel

    for args in ((True, True), (True, False), (False, False)):
        sel = fill(*args)
        if len(sel) == n:
            return [r["sid"] for r in sel]
    return [r["sid"] for r in (sel + [r for r in rows if r not in sel])[:n]]


def test_diverse_selection_matches_the_plain_rule(spark):
    rng = np.random.default_rng(5)
    rows = []
    for t in range(40):
        spread = rng.integers(1, 6)
        for i in range(rng.integers(3, 60)):
            sec = int(rng.integers(0, spread))
            rows.append({"t": t, "sid": i, "company": f"c{rng.integers(0, 25)}", "sector": f"s{sec}", "subsector": ["", f"u{rng.integers(0, 4)}"][int(rng.integers(0, 2))],
                         "theme": f"m{sec % 3}", "score": float(np.round(rng.uniform(20, 90), 1))})
    got = L.select_diverse(spark.createDataFrame(pd.DataFrame(rows)), ["t"]).orderBy("t", "position").toPandas().groupby("t")["sid"].apply(list)
    for t in range(40):
        day = sorted((r for r in rows if r["t"] == t), key=lambda r: (-r["score"], r["sid"]))
        assert got[t] == greedy(day), t


def test_neutral_means_zero_by_sector(spark):
    pdf = pd.DataFrame({"k": 1, "sid": range(30), "sector": [i % 3 for i in range(30)], "v": np.arange(30.0) ** 2})
    out = X.sector_neutral(spark.createDataFrame(pdf), ["k"], "sector", "v").groupBy("sector").agg(F.avg("neutral").alias("m")).collect()
    assert all(math.isclose(r.m, 0, abs_tol=1e-12) for r in out)
    assert pytest.approx(0) == sum(r.m for r in out)


@pytest.mark.parametrize("value", [
    "id", "id + 1000000000", "concat('BR-ISSUER-000-', lpad(id, 9, '0'))", "id * id * id",
    "concat(if(id % 2 = 0, 'user_0001_', 'zz'), sha2(cast(id as string), 256))"])
def test_chunks_of_ids_are_even(spark, value):
    """A million ids, close together, with a common prefix or far apart: no chunk holds over twice the median."""
    hist = spark.range(1_000_000).select(F.lit("d").alias("k"), F.expr(value).alias("v"), F.lit(1).alias("m"))
    sizes = [r["count"] for r in X.chunked(hist, "v", chunks=256).groupBy("_chunk").count().collect()]
    assert sum(sizes) == 1_000_000 and len(sizes) == 256 and max(sizes) <= 2 * np.median(sizes)


@pytest.mark.parametrize("make", [str, int])
def test_ranks_over_sampled_chunks(spark, make):
    """Split points from a few of the rows, with repeated values and a single chunk that holds most: ranks still equal those of pandas."""
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 4000), "v": [make(x) for x in np.where(rng.random(4000) < 0.5, 10**9, 10**9 + rng.integers(-500, 500, 4000))]})
    got = X.with_average_rank(spark.createDataFrame(pdf.assign(i=range(4000))), ["k"], "v", "r").toPandas().sort_values("i")
    assert np.allclose(got["r"], pdf.groupby("k")["v"].rank())
    hist = X.histogram(spark.createDataFrame(pdf), ["k"], "v")
    order = sorted((r["v"], r["_chunk"]) for r in X.chunked(hist, "v", chunks=7, sample=30).collect())
    assert [c for _, c in order] == sorted(c for _, c in order) and len({c for _, c in order}) > 3


def test_chunks_of_an_empty_histogram(spark):
    hist = spark.createDataFrame([], "k int, v string, m long")
    assert X.ranked(hist, ["k"], "v").count() == 0
