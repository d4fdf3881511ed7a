"""The Wilder stream over ticks that come in any order."""
import datetime as dt
import random

import pandas as pd
import pytest

from factorspark.streaming import jobs as J

TICK = "user_id long, ts timestamp, event_id long, value double, event_type string"


def plain(prices):
    d = [b - a for a, b in zip(prices, prices[1:])]
    if len(d) < J.PERIOD:
        return None
    means = [sum(f(x) for x in d[:14]) / 14 for f in (lambda x: max(x, 0), lambda x: max(-x, 0), abs)]
    for x in d[14:]:
        means = [(m * 13 + v) / 14 for m, v in zip(means, (max(x, 0), max(-x, 0), abs(x)))]
    return len(d), 100 - 100 / (1 + means[0] / means[1]), means[2]


def test_steps_over_any_cut_equal_one_pass():
    rng = random.Random(1)
    prices = [rng.uniform(5, 15) for _ in range(60)]
    for cuts in ([], [1], [5, 14, 15], [14], [15, 16, 40], list(range(1, 60))):
        state = None
        for a, b in zip([0, *cuts], [*cuts, 60]):
            state = J.wilder_step(state, prices[a:b], 7)
        n, rsi, atr = plain(prices)
        assert state[0] == n and state[2] == 7 and state[5] == pytest.approx(atr) and 100 - 100 / (1 + state[3] / state[4]) == pytest.approx(rsi)


def test_shuffled_batches_equal_ordered_ticks(spark, tmp_path):
    """Two batches hold a random half of the ticks each, then a late day moves the watermark past them."""
    rng = random.Random(3)
    day = dt.datetime(2024, 1, 1)
    ticks = [(s, day + dt.timedelta(minutes=rng.randrange(2400)), i * 3 + s, rng.uniform(5, 15), "click") for s in (0, 1, 2) for i in range(40 if s else 9)]
    rng.shuffle(ticks)
    own = J.stateful_session(spark)
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    batches = [ticks[: len(ticks) // 2], ticks[len(ticks) // 2 :], [(9, day + dt.timedelta(days=20), 999, 1.0, "click")], [(0, day, 1000, 77.0, "click")]]
    for batch in batches:
        own.createDataFrame(batch, TICK).coalesce(1).write.mode("append").parquet(source)
        stream = J.tick_stream(own, source, "*.parquet", own.createDataFrame([], TICK).schema)
        got = J.latest_of(J.wilder_in_order(stream), folder, "sid").collect()
    want = {}
    for s in (0, 1, 2):
        found = plain([p for _, _, p in sorted((t, e, p) for sid, t, e, p, _ in ticks if sid == s)])
        if found:
            want[s] = found
    assert {r.sid: (r.n, pytest.approx(r.rsi), pytest.approx(r.atr)) for r in got} == want and set(want) == {1, 2}


def test_the_callers_session_keeps_its_settings(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    assert J.stateful_session(spark).conf.get(name) != before and spark.conf.get(name) == before
