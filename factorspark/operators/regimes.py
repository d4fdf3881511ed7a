"""Market regimes, benchmark alignment, month-end forward returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.operators import timeseries as ts
from factorspark.operators.prefixes import expanding_median

VOL_WINDOW = 21


def vol_regime(prices: DataFrame, key: str, min_returns: int = 100) -> DataFrame:
    """Regime of every session from realised volatility against its expanding median.

    ``prices``: key, date, sno, close.
    """
    w = Window.partitionBy(key).orderBy("sno")
    df = prices.select(key, "date", "sno", ts.returns("close", w).alias("r"))
    frame = w.rowsBetween(-(VOL_WINDOW - 1), 0)
    vol = F.when(F.count("r").over(frame) >= VOL_WINDOW, F.stddev_samp("r").over(frame) * F.sqrt(F.lit(252.0)))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("vol", F.nanvl(vol, F.lit(None).cast("double"))).withColumn("n", F.count("r").over(run))
    return expanding_median(df, [key], "sno", "vol").withColumn(
        "regime", F.when((F.col("n") < min_returns) | (F.col("med") <= 0), "mean_rev")
        .when(F.col("vol") > 1.5 * F.col("med"), "bear").when(F.col("vol") < F.col("med"), "risk_on").otherwise("mean_rev"))


def rule_regime(index: DataFrame) -> DataFrame:
    """Index above its 200-session mean and calm fear gauge; ``index``: date, sno, close, vix.

    One index series: the window holds one row per session.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("sno").rowsBetween(-199, 0)
    above = (F.count("*").over(w) >= 200) & (F.col("close") > F.avg("close").over(w))
    calm = F.col("vix").isNull() | (F.col("vix") < 18)
    return index.withColumn("regime", F.when(F.col("vix") > 25, "bear").when(above & calm, "risk_on").otherwise("mean_rev"))


def macro_sentiment(series: DataFrame) -> DataFrame:
    """Daily change and direction per symbol, and the risk mood of the day.

    ``series``: date, symbol, value for the symbols vix, sp500 and dxy.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    prev = F.lag("value").over(w)
    df = series.withColumn("change", F.col("value") / F.when(prev != 0, prev) - 1)

    def of(symbol, col):
        return F.max(F.when(F.col("symbol") == symbol, F.col(col)))

    day = df.groupBy("date").agg(of("vix", "value").alias("vix"), of("sp500", "change").alias("sp"), of("dxy", "change").alias("dx"))
    sp, dx, vix = F.col("sp"), F.col("dx"), F.col("vix")
    mood = (F.when(vix > 25, "risk_off").when((sp < -0.015) & (dx > 0.005), "risk_off")
            .when((vix < 18) & (sp > 0.005), "risk_on").otherwise("neutral"))
    return day.withColumn("direction", F.when(sp > 0.001, "up").when(sp < -0.001, "down").otherwise("flat")).withColumn("sentiment", mood)


def cdi_on_dates(cdi: DataFrame, dates: DataFrame) -> DataFrame:
    """Rate compounded between consecutive dates of another calendar; 0 on the first."""
    one = F.lit(1)
    w = Window.partitionBy("_k").orderBy("date")
    level = cdi.withColumn("_k", one).withColumn("level", F.product(1 + F.col("cdi")).over(w))
    hit = ts.asof(dates.select(F.col("date").alias("d")).withColumn("_k", one), level.select("_k", "date", "level"),
                  ["_k"], "d", "date", ["level"])
    before = F.lag("level").over(Window.partitionBy("_k").orderBy("d"))
    return hit.select(F.col("d").alias("date"), F.coalesce(F.col("level") / before - 1, F.lit(0.0)).alias("ret"))


def month_forward_return(bars: DataFrame, months: DataFrame, value: str = "close") -> DataFrame:
    """Return from a month-end price to the last price seen by the next month end; 0 if none.

    Each bar carries its month; the last bar of the following month is the neighbour row when the
    months are adjacent, so one window over (security, month) answers all months.
    """
    bars = bars.withColumn("month", F.trunc("date", "month"))
    m = bars.groupBy("sid", "month").agg(F.max("date").alias("last_date"), F.max_by(value, "date").alias("last_value"))
    w = Window.partitionBy("sid").orderBy("month")
    nxt = F.when(F.lead("month").over(w) == F.add_months("month", 1), F.lead("last_value").over(w))
    m = m.withColumn("next_value", nxt)
    at_end = m.join(months.select("month", "t", "t_next").filter("t_next is not null"), "month").filter("last_date = t")
    return at_end.select("sid", "t", F.coalesce(F.col("next_value") / F.col("last_value") - 1, F.lit(0.0)).alias("fwd"))


def forward_h(value: str, h: int, last_sno: str = "last_sno") -> Column:
    """Return to the last price within the next ``h`` sessions, if the panel reaches that far."""
    w = Window.partitionBy("sid").orderBy("sno").rangeBetween(0, h)
    return F.when(F.col("sno") + h <= F.col(last_sno), F.last(value, ignorenulls=True).over(w) / F.col(value) - 1)


def etf_check(dates: DataFrame, index: DataFrame, etf: DataFrame, tolerance: float = 0.015) -> DataFrame:
    """Index return between consecutive dates against a fund that tracks it."""
    w = Window.partitionBy(F.lit(1)).orderBy("t")
    at = (dates.join(index, dates.t == index.date).select("t", "close")
          .join(etf, F.col("t") == etf.date).select("t", "close", "etf"))
    r, e = F.col("close") / F.lag("close").over(w) - 1, F.col("etf") / F.lag("etf").over(w) - 1
    out = at.withColumn("index_ret", r).withColumn("etf_ret", e).filter("index_ret is not null")
    gap = F.col("index_ret") - F.col("etf_ret")
    return out.withColumn("gap_pp", gap * 100).withColumn("consistent", F.abs(gap) <= tolerance)
