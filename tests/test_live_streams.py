"""Levels in force and bars that are revised, over several batches."""
import datetime as dt
import random

import pytest

from factorspark.streaming import jobs as J

TICK = "user_id long, ts timestamp, event_id long, value double, event_type string"
DAY = dt.datetime(2024, 1, 1)


def feed(own, rows, source):
    own.createDataFrame(rows, TICK).coalesce(1).write.mode("append").parquet(source)
    return J.tick_stream(own, source, "*.parquet", own.createDataFrame([], TICK).schema)


def plain_alerts(rows):
    """Each tick against the version with the greatest (time, number) up to its instant."""
    found = set()
    for sid, ts, _, px, kind in rows:
        held = max(((t, e, p) for s, t, e, p, k in rows if s == sid and k == "purchase" and t <= ts), default=None)
        if kind == "purchase" or held is None or px <= 0:
            continue
        stop, target = held[2] * 0.9, held[2] * 1.2
        if stop > 0 and px <= stop:
            found.add((sid, ts.date(), "stop_hit"))
        elif stop > 0 and (px - stop) / px < 0.02:
            found.add((sid, ts.date(), "stop_near"))
        if target > 0 and px >= target and not (stop > 0 and px <= stop):
            found.add((sid, ts.date(), "target_hit"))
    return found


def test_levels_change_between_batches(spark, tmp_path):
    """Ticks and versions in two shuffled batches, with ties in time and a level of zero; then the watermark passes them, and a late pair is dropped."""
    rng = random.Random(5)
    rows = [(i % 3, DAY + dt.timedelta(minutes=30 * rng.randrange(60)), i, 0.0 if i == 17 else rng.uniform(7, 13), "purchase" if i % 6 < 2 else "click") for i in range(150)]
    rng.shuffle(rows)
    own = J.stateful_session(spark)
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    end = DAY + dt.timedelta(days=20)
    for batch in (rows[:70], rows[70:], [(9, end, 999, 1.0, "click")], [(0, DAY, 1000, 10.0, "purchase"), (0, DAY, 1001, 0.1, "click")]):
        ticks = feed(own, batch, source)
        entries = ticks.filter("event_type = 'purchase'").selectExpr("sid", "ts", "event_id AS version", "px * 0.9 AS stop", "px * 1.2 AS target")
        got = J.run_to_table(J.level_alerts_in_force(ticks.filter("event_type <> 'purchase'"), entries), folder, "alerts").collect()
    want = plain_alerts(rows)
    assert len(got) == len(want) and {(r.sid, r.day, r.kind) for r in got} == want and {k for _, _, k in want} == {"stop_hit", "stop_near", "target_hit"}


def test_alerts_are_the_same_over_any_cut():
    rng = random.Random(7)
    rows = sorted((rng.randrange(40) * 3_600_000_000, rng.random() < 0.7, i, rng.uniform(7, 13), 9.0 + i % 3, 11.5) for i in range(60))
    due = [(us, tick, i, px if tick else None, None if tick else stop, None if tick else target) for us, tick, i, px, stop, target in rows]
    whole, *last = J.alerts_in_force(due, None, None)
    for cut in range(1, 59, 7):
        first, *held = J.alerts_in_force(due[:cut], None, None)
        second, *end = J.alerts_in_force(due[cut:], *held)
        assert first + second == whole and end == last


def test_a_day_is_provisional_then_final_once(spark, tmp_path):
    own = J.stateful_session(spark)
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    at = lambda day, hour: DAY + dt.timedelta(days=day, hours=hour)
    batches = [
        [(1, at(0, 10), 1, 5.0, "click"), (1, at(0, 12), 2, 7.0, "click"), (1, at(1, 9), 3, 8.0, "click")],
        [(1, at(0, 9), 4, 4.0, "click"), (2, at(0, 9), 5, 1.0, "click")],  # late, inside the watermark
        [(9, at(20, 0), 6, 1.0, "click")],
        [(1, at(0, 11), 7, 99.0, "click")],  # behind it
    ]
    for batch in batches:
        got = J.run_updates(J.revised_bars(feed(own, batch, source)), folder).collect()
    bars = sorted((r.sid, r.date.day, r.revision, r.final, r.open, r.high, r.low, r.close, r.volume, r.trades) for r in got if r.sid != 9)
    assert bars == [
        (1, 1, 1, False, 5.0, 7.0, 5.0, 7.0, 12.0, 2), (1, 1, 2, False, 4.0, 7.0, 4.0, 7.0, 16.0, 3), (1, 1, 3, True, 4.0, 7.0, 4.0, 7.0, 16.0, 3),
        (1, 2, 1, False, 8.0, 8.0, 8.0, 8.0, 8.0, 1), (1, 2, 2, True, 8.0, 8.0, 8.0, 8.0, 8.0, 1),
        (2, 1, 1, False, 1.0, 1.0, 1.0, 1.0, 1.0, 1), (2, 1, 2, True, 1.0, 1.0, 1.0, 1.0, 1.0, 1)]
    assert [(r.sid, r.revision, r.final) for r in got if r.sid == 9] == [(9, 1, False)]


@pytest.mark.parametrize("cut", [1, 4, 11])
def test_bars_merge_in_any_order(cut):
    import pandas as pd

    rng = random.Random(cut)
    ticks = pd.DataFrame([{"ts": pd.Timestamp(DAY) + pd.Timedelta(hours=rng.randrange(60)), "event_id": i, "px": float(rng.randrange(1, 99))} for i in range(12)])
    parts = J._parts(ticks)
    both = J.merged_bars(pd.concat([J.merged_bars(parts[:cut]), J.merged_bars(parts[cut:])]))
    pd.testing.assert_frame_equal(both, J.merged_bars(parts))
    day = ticks.sort_values(["ts", "event_id"]).groupby(ticks["ts"].dt.date)["px"]
    assert both["open"].tolist() == day.first().tolist() and both["close"].tolist() == day.last().tolist() and both["volume"].tolist() == day.sum().tolist()
