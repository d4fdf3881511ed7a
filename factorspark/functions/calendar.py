"""Exchange calendar as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorspark.functions.scalars import easter

# Closed days by month-day, and by distance from Easter Sunday.
FIXED_HOLIDAYS = ("01-01", "04-21", "05-01", "09-07", "10-12", "11-02", "11-15", "12-24", "12-25", "12-31")
EASTER_OFFSETS = (-48, -47, -2, 60)
NOVEMBER_20_SINCE = 2024
LONGEST_CLOSURE = 10


def is_holiday(d: Column) -> Column:
    from_easter = F.datediff(d, easter(F.year(d)))
    return (F.date_format(d, "MM-dd").isin(*FIXED_HOLIDAYS) | from_easter.isin(*EASTER_OFFSETS)
            | ((F.date_format(d, "MM-dd") == "11-20") & (F.year(d) >= NOVEMBER_20_SINCE)))


def is_trading_day(d: Column) -> Column:
    return (F.weekday(d) < 5) & ~is_holiday(d)


def previous_trading_day(d: Column) -> Column:
    """Last trading day strictly before ``d``."""
    before = F.transform(F.sequence(F.lit(1), F.lit(LONGEST_CLOSURE)), lambda k: F.date_sub(d, k))
    return F.filter(before, is_trading_day)[0]


def last_trading_day(d: Column) -> Column:
    """Last trading day on or before ``d``."""
    return F.when(is_trading_day(d), d).otherwise(previous_trading_day(d))


def day_table(days: DataFrame, date: str = "date") -> DataFrame:
    """Calendar columns of a table of distinct days."""
    d = F.col(date)
    df = days.withColumn("trading", is_trading_day(d)).withColumn("prev_trading", previous_trading_day(d))
    prev = F.col("prev_trading")
    return (df.withColumn("holiday", is_holiday(d))
            .withColumn("last_trading", F.when(F.col("trading"), d).otherwise(prev))
            .withColumn("weekly_run", F.col("trading") & (F.trunc(prev, "week") != F.trunc(d, "week")))
            .withColumn("monthly_run", F.col("trading") & (F.trunc(prev, "month") != F.trunc(d, "month"))))


def with_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """Adds trading-day, holiday and run-gate columns, worked out once per distinct day."""
    return df.join(day_table(df.select(date).distinct(), date), date)


def trading_days(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row per trading day of each row's closed interval."""
    rows = df.withColumn("day", F.explode(F.sequence(F.col(start), F.col(end))))
    days = rows.select("day").distinct().filter(is_trading_day(F.col("day")))
    return rows.join(days, "day", "left_semi")


def is_intraday(ts: Column, opened: str = "10:00", settled: str = "18:30") -> Column:
    """A trading day's clock time before the session has settled."""
    clock = F.date_format(ts, "HH:mm")
    return is_trading_day(F.to_date(ts)) & (clock >= opened) & (clock < settled)
