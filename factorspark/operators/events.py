"""Event windows, entry sessions, rotations, small dimension maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.operators import timeseries as ts

CLOSE_HOUR = 17
DRIFT_ENTRY, DRIFT_HOLDING, EVENT_TOLERANCE_DAYS = 5, 60, 3


def nearest_session(events: DataFrame, bars: DataFrame, tolerance: int = EVENT_TOLERANCE_DAYS,
                    values: list[str] | None = None) -> DataFrame:
    """First session on or after the event date, if at most ``tolerance`` days later."""
    hit = ts.asof(events, bars, ["sid"], "event_date", "date", values or [], forward=True)
    return hit.filter(F.datediff("date_matched", "event_date") <= tolerance)


def pead_signal(events: DataFrame, prices: DataFrame, index: DataFrame, as_of: Column) -> DataFrame:
    """Drift after an announcement: return around the event against the index, fading to zero.

    Valid from 5 to 60 approximate business days after the event; needs a session on each side.
    """
    business = F.datediff(as_of, F.col("event_date")) * 5 / 7
    live = events.withColumn("bd", business).filter(F.col("bd").between(DRIFT_ENTRY, DRIFT_HOLDING))
    w = ts.by_row()
    around = prices.withColumn("p0", F.lag("close").over(w)).withColumn("p1", F.lead("close").over(w))
    hit = nearest_session(live, around, values=["p0", "p1"]).drop("date_matched")
    # the index is one series: its neighbours are looked up by date on the session calendar
    wi = Window.partitionBy("_k").orderBy("date")
    idx = index.withColumn("_k", F.lit(1)).withColumn("m0", F.lag("close").over(wi)).withColumn("m1", F.lead("close").over(wi))
    dates = hit.select("event_date").distinct().withColumn("_k", F.lit(1))
    market = ts.asof(dates, idx, ["_k"], "event_date", "date", ["m0", "m1"], forward=True).select("event_date", "m0", "m1")
    hit = hit.join(market, "event_date").filter("p0 > 0 and p1 > 0 and m0 > 0 and m1 > 0")
    life = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (DRIFT_HOLDING - F.col("bd")) / (DRIFT_HOLDING - DRIFT_ENTRY)))
    ear = F.col("p1") / F.col("p0") - F.col("m1") / F.col("m0")
    return hit.select("sid", "event_date", (ear * life).alias("pead_signal"))


def entry_session(runs: DataFrame, sessions: DataFrame) -> DataFrame:
    """First close a recommendation can trade at; a run after the close waits for the next session.

    Adds ``entry_date`` and ``entry_sno``. Only the distinct run days meet the calendar.
    """
    late = F.hour("run_at") >= CLOSE_HOUR
    day = F.date_add(F.to_date("run_at"), late.cast("int"))
    days = runs.select(day.alias("_day")).distinct().withColumn("_k", F.lit(1))
    cal = ts.asof(days, sessions.withColumn("_k", F.lit(1)), ["_k"], "_day", "date", ["sno"], forward=True)
    return (runs.withColumn("_day", day).join(cal.drop("_k"), "_day", "left").drop("_day")
            .withColumnsRenamed({"sno": "entry_sno", "date_matched": "entry_date"}))


def rotation(previous: DataFrame, current: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Securities leaving and entering; ``on`` may name a period beside the security."""
    on = on or ["sid"]
    out = previous.join(current, on, "left_anti").withColumn("side", F.lit("exit"))
    return out.unionByName(current.join(previous, on, "left_anti").withColumn("side", F.lit("entry")))


def with_theme(df: DataFrame, themes: dict[str, str]) -> DataFrame:
    """Sector to macro theme by a literal map (a handful of entries shipped inside the plan)."""
    m = F.create_map(*[F.lit(x) for kv in themes.items() for x in kv])
    return df.withColumn("theme", F.coalesce(F.try_element_at(m, F.col("sector")), F.lit("other")))
