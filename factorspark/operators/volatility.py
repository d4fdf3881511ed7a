"""Volatility estimators at the last session of each security."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.operators import timeseries as ts

LAMBDA = 0.94


def last_rows(df: DataFrame, n: int, key: str = "sid", order: str = "date") -> DataFrame:
    """The last ``n`` rows of each key. The rank limit is applied per task before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_j", F.row_number().over(w)).filter(F.col("_j") <= n).drop("_j")


def yang_zhang(bars: DataFrame, window: int = 180, min_rows: int = 20, key: str = "sid") -> DataFrame:
    """Yearly Yang-Zhang volatility from open, high, low, close."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    rows = last_rows(bars, window, key).filter((o > 0) & (h > 0) & (l > 0) & (c > 0))
    w = ts.by_row(key)
    rows = (rows.withColumn("night", F.log(o / F.lag("close").over(w))).withColumn("day", F.log(c / o))
            .withColumn("rs", F.log(h / o) * F.log(h / c) + F.log(l / o) * F.log(l / c)))
    g = rows.groupBy(key).agg(F.count("*").alias("n"), F.var_samp("night").alias("vn"),
                              F.var_samp("day").alias("vd"), F.avg("rs").alias("rs"))
    n = F.col("n")
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    var = F.coalesce("vn", F.lit(0.0)) + k * F.coalesce("vd", F.lit(0.0)) + (1 - k) * F.col("rs")
    return g.select(key, F.when((n >= min_rows) & (var > 0), F.sqrt(var * 252)).alias("vol_yz"))


def close_to_close(bars: DataFrame, window: int = 180, key: str = "sid") -> DataFrame:
    """Yearly deviation of the last ``window`` close returns."""
    w = ts.by_row(key)
    rows = bars.select(key, "date", ts.returns("close", w).alias("r")).filter("r is not null")
    return last_rows(rows, window, key).groupBy(key).agg(
        F.when(F.count("*") >= 29, F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("vol_cc"))


def ewma_vol(returns: DataFrame, keys: list[str], ret: str = "ret", order: str = "date",
             window: int = 251, min_rows: int = 30, lam: float = LAMBDA) -> DataFrame:
    """Yearly RiskMetrics volatility after the last return of each key.

    The recurrence s = lam·s + (1-lam)·r² started at the first squared return unrolls to one
    weighted sum; the oldest return keeps its full weight.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    rows = returns.filter(F.col(ret).isNotNull()).withColumn("_j", F.row_number().over(w)).filter(F.col("_j") <= window)
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    j, n = F.col("_j"), F.col("_n")
    weight = F.when(j == n, F.pow(F.lit(lam), (n - 1).cast("double"))).otherwise(
        (1 - lam) * F.pow(F.lit(lam), (j - 1).cast("double")))
    var = F.sum(weight * F.col(ret) * F.col(ret))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.count("*") >= min_rows, F.sqrt(var * 252)).alias("vol_ewma"))


def gross_exposure(vol: Column, target: float = 0.14, lo: float = 0.5, hi: float = 1.0) -> Column:
    """Share of capital at risk that meets the volatility target; 1 without an estimate."""
    raw = F.lit(target) / F.when(vol > 0, vol)
    return F.coalesce(F.when(raw.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), raw))), F.lit(1.0))


def adv_median(bars: DataFrame, window: int = 21, key: str = "sid") -> DataFrame:
    """Median of close times traded quantity over the last ``window`` rows."""
    return last_rows(bars, window, key).groupBy(key).agg(
        F.percentile(F.col("close") * F.col("quantity"), 0.5).alias("adv"))


def beta(returns: DataFrame, market: DataFrame, window: int = 252, min_rows: int = 60) -> DataFrame:
    """Slope of each security's returns on the market over its last common returns.

    ``returns``: sid, date, r; ``market``: date, m. The market has one row per session.
    """
    rows = last_rows(returns.filter("r is not null").join(market.filter("m is not null"), "date"), window)
    var = F.var_samp("m")
    return rows.groupBy("sid").agg(F.when((F.count("*") >= min_rows) & (var > 0), F.covar_samp("r", "m") / var).alias("beta"))


def fx_corr(returns: DataFrame, fx: DataFrame, window: int = 90, min_rows: int = 30) -> DataFrame:
    """Correlation of the last log returns with the currency's log returns on common dates."""
    rows = last_rows(returns.filter("r is not null").join(fx.filter("m is not null"), "date"), window)
    return rows.groupBy("sid").agg(F.when(F.count("*") >= min_rows, F.corr("r", "m")).alias("corr"))
