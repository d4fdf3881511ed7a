"""Medians of growing prefixes and exponential averages against pandas and plain loops."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorspark.operators import prefixes
from factorspark.operators.prefixes import expanding_median
from factorspark.operators.technical import technical_panel


def expect(rows):
    df = pd.DataFrame(rows, columns=["k", "t", "v"]).sort_values(["k", "t"])
    df["med"] = df.groupby("k", dropna=False)["v"].transform(lambda s: s.astype(float).expanding(1).median())
    return {(r.k, r.t): None if np.isnan(r.med) else r.med for r in df.itertuples()}


def check(spark, rows):
    got = expanding_median(spark.createDataFrame(rows, "k string, t long, v double"), ["k"], "t", "v").collect()
    want = expect(rows)
    assert len(got) == len(want)
    assert {(r.k, r.t): r.med for r in got} == pytest.approx(want, abs=1e-12, nan_ok=False)


@pytest.mark.parametrize("seed", range(3))
def test_median_of_prefixes(spark, monkeypatch, seed):
    monkeypatch.setattr(prefixes, "SIZES", (16, 4))  # both splits at work on a short series
    rng, rows = random.Random(seed), []
    shapes = {"rising": lambda t: float(t), "falling": lambda t: -float(t), "ties": lambda t: float(rng.randrange(3)), "noise": lambda t: rng.gauss(0, 1),
              "jump": lambda t: rng.random() + (100 if t > 80 else 0), "gaps": lambda t: rng.choice([None, float("nan"), rng.random()]), "flat": lambda t: 5.0}
    for k, f in shapes.items():
        times = sorted(rng.sample(range(400), 150)) if k in ("noise", "gaps") else range(150)
        rows += [(k, t, f(t)) for t in times]
    rows += [("one", 7, 1.0), ("none", 0, None), ("none", 1, None)]
    check(spark, rows)


def test_long_series(spark):
    rng = np.random.default_rng(1)
    rows = [("walk", i, float(v)) for i, v in enumerate(np.cumsum(rng.normal(size=6000)))] + [("level", i, float(v)) for i, v in enumerate(rng.normal(size=4000))]
    check(spark, rows)


def test_empty_clash_and_plan(spark):
    empty = spark.createDataFrame([], "k string, t long, v double")
    out = expanding_median(empty, ["k"], "t", "v")
    assert out.count() == 0 and out.columns == ["k", "t", "v", "med"]
    assert "Python" not in out._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        expanding_median(empty.withColumn("_v", F.lit(1)), ["k"], "t", "v")


def test_macd_equals_the_recurrence(spark):
    rng, rows, want = random.Random(3), [], {}
    for sid, n in ((1, 35), (2, 80), (3, 400), (4, 34), (5, 60)):
        closes = [10.0] * n if sid == 5 else [rng.uniform(5, 15) for _ in range(n)]
        rows += [(sid, d, c) for d, c in enumerate(closes)]
        f = w = closes[0]
        g = h = 0.0
        for c in closes[1:]:
            f, w = f + 2 / 13 * (c - f), w + 2 / 27 * (c - w)
            g += 0.2 * (f - w - g)
            last, h = h, f - w - g
        cross = "bullish" if last < 0 <= h else "bearish" if last > 0 >= h else None
        want[sid] = (f, w, g, h, cross) if n >= 35 else (None,) * 5
    bars = spark.createDataFrame(rows, "sid long, d int, close double").selectExpr("sid", "date_add(date'2020-01-01', d) date", "close open", "close", "1d volume")
    got = {r.sid: (r.ema_fast, r.ema_slow, r.macd_signal, r.macd_hist, r.macd_cross) for r in technical_panel(bars).collect()}
    for sid, row in want.items():
        assert got[sid][:4] == pytest.approx(row[:4], abs=1e-9) and got[sid][4] == row[4]
    assert got[5][3] == 0.0
