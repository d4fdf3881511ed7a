"""Statistics of return and IC series.

A series is one strategy or factor over time: at most one row per period, so its windows are
bounded by the calendar while any number of series runs in parallel.
"""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.normal import norm_cdf, norm_ppf, student_t_p
from factorspark.operators import xsection as X

EULER_GAMMA = 0.5772156649
POWER_Z = 1.959963984540054 + 0.8416212335729143  # two-sided 5% and 80% power


def rank_ic(df: DataFrame, keys: list[str], signal: str, forward: str, min_n: int = 20) -> DataFrame:
    """Spearman correlation per key over rows with both values; null below ``min_n`` rows or
    without spread. Twelve digits are kept, so a correlation of zero has no sign."""
    both = df.filter(F.col(signal).isNotNull() & F.col(forward).isNotNull()).select(*keys, "sid", signal, forward)
    r = X.with_average_rank(X.with_average_rank(both, keys, signal, "_a"), keys, forward, "_b")
    g = r.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("c"), F.stddev_pop("_a").alias("_sa"),
                             F.stddev_pop("_b").alias("_sb"))
    ok = (F.col("n") >= min_n) & (F.col("_sa") > 0) & (F.col("_sb") > 0)
    return g.select(*keys, "n", F.when(ok, F.round("c", 12)).alias("ic"))


def _demeaned(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    rows = df.filter(F.col(value).isNotNull())
    return rows.withColumn("_d", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))


def newey_west(df: DataFrame, keys: list[str], value: str, order: str, lags: int | Column, out: str = "t_nw") -> DataFrame:
    """Mean and its t statistic with Bartlett-weighted autocovariances up to ``lags``, which may be a column (constant per key).

    A number of lags becomes as many columns of one window. Lags from a column are rows: each observation is
    paired by equality with those up to its key's lag before it, however long that is.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    d = _demeaned(df, keys, value).withColumn("_L", F.lit(lags) if isinstance(lags, int) else lags)
    sums = [F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum(F.col("_d") * F.col("_d")).alias("_g0")]
    if isinstance(lags, int):
        for k in range(1, lags + 1):
            d = d.withColumn(f"_p{k}", F.col("_d") * F.lag("_d", k).over(w))
        g = d.groupBy(*keys).agg(*sums, *[F.sum(f"_p{k}").alias(f"_g{k}") for k in range(1, lags + 1)])
        cross = sum((F.coalesce(F.col(f"_g{k}"), F.lit(0.0)) * (1 - k / (lags + 1)) for k in range(1, lags + 1)), F.lit(0.0))
    else:
        d = d.withColumn("_i", F.row_number().over(w))
        late = d.select(*keys, "_i", "_d", "_L").filter((F.col("_L") >= 1) & (F.col("_i") >= 2))
        late = late.withColumn("_k", F.explode(F.sequence(F.lit(1), F.least(F.col("_L"), F.col("_i") - 1))))
        pairs = late.withColumn("_j", F.col("_i") - F.col("_k")).drop("_i").join(d.select(*keys, F.col("_i").alias("_j"), F.col("_d").alias("_e")), [*keys, "_j"])
        c = pairs.groupBy(*keys).agg(F.sum(F.col("_d") * F.col("_e") * (1 - F.col("_k") / (F.col("_L") + 1))).alias("_c"))
        g = d.groupBy(*keys).agg(*sums).join(c, keys, "left")
        cross = F.coalesce(F.col("_c"), F.lit(0.0))
    var = (F.col("_g0") + 2 * cross) / F.col("n")
    t = F.col("mean") / F.sqrt(var / F.col("n"))
    return g.select(*keys, "n", "mean", F.when((F.col("n") >= 3) & (var > 1e-300), t).alias(out))


def sharpe(mean: Column, std: Column, n: Column, periods: float = 12, min_n: int = 6) -> Column:
    return F.when((n >= min_n) & (std > 0), mean / std * math.sqrt(periods))


def series_moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, deviation, and third and fourth central moment means of each series."""
    d = F.col("_d")
    return _demeaned(df, keys, value).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.avg(d * d).alias("m2"),
        F.avg(d * d * d).alias("m3"), F.avg(d * d * d * d).alias("m4"))


def study_shape() -> tuple[Column, Column]:
    """Skewness and kurtosis over the sample deviation (the study's convention)."""
    s = F.col("std")
    return F.col("m3") / F.pow(s, F.lit(3.0)), F.col("m4") / F.pow(s, F.lit(4.0))


def unbiased_shape() -> tuple[Column, Column]:
    """Bias-corrected skewness and kurtosis (kurtosis 3 for a normal sample)."""
    n = F.col("n").cast("double")
    g1 = F.col("m3") / F.pow("m2", F.lit(1.5))
    g2 = F.col("m4") / (F.col("m2") * F.col("m2")) - 3
    skew = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return skew, kurt + 3


def probabilistic_sharpe(sr: Column, n: Column, skew: Column, kurt: Column, benchmark: Column | float = 0.0,
                         floor: float | None = 1e-12) -> Column:
    """Probability that the true per-period Sharpe ratio exceeds the benchmark.

    A non-positive variance term is floored (study) or gives null (``floor=None``).
    """
    var = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    safe = F.greatest(var, F.lit(floor)) if floor is not None else F.when(var > 0, var)
    return norm_cdf((sr - benchmark) * F.sqrt((n - 1).cast("double")) / F.sqrt(safe))


def expected_max_sharpe(n_trials: int, sr_var: Column) -> Column:
    """Best Sharpe ratio to expect from ``n_trials`` attempts without skill."""
    if n_trials < 2:
        return F.lit(0.0)
    a, b = norm_ppf(F.lit(1 - 1 / n_trials)), norm_ppf(F.lit(1 - 1 / (n_trials * math.e)))
    return F.sqrt(sr_var) * ((1 - EULER_GAMMA) * a + EULER_GAMMA * b)


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str, tie: str, level: float = 0.05) -> DataFrame:
    """q-value and step-up rejection of every test within its family (a family is a list of
    factor tests, bounded by the factor configuration)."""
    w = Window.partitionBy(*keys).orderBy(p, tie)
    back = Window.partitionBy(*keys).orderBy(F.col(p).desc(), F.col(tie).desc())
    m = F.count("*").over(Window.partitionBy(*keys))
    rows = df.filter(F.col(p).isNotNull()).withColumn("_i", F.row_number().over(w)).withColumn("_m", m)
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_i")).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("q_value", q).withColumn("reject", F.col("q_value") <= level).drop("_i", "_m")


def nw_lag(days: Column) -> Column:
    """Overlap of weekly observations of a horizon in trading days."""
    return F.greatest(F.lit(0), F.ceil(days / 5) - 1).cast("int")


def ic_summary(ics: DataFrame, keys: list[str], days: str, min_eff: int = 8) -> DataFrame:
    """Mean IC, information ratio, hit rate and Newey-West test of each (factor, horizon).

    Tested only with at least ``min_eff`` independent windows; ``ics``: keys, date, days, ic, n_tickers.
    """
    rows = ics.filter("ic is not null").withColumn("_lag", nw_lag(F.col(days)))
    g = rows.groupBy(*keys).agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("sd"), F.count("*").alias("n_obs"),
                                F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"), F.max("_lag").alias("lag"),
                                F.avg("n_tickers").alias("mean_n"))
    nw = newey_west(rows, keys, "ic", "date", F.col("_lag")).select(*keys, "t_nw")
    n_eff = F.col("n_obs") / (F.col("lag") + 1)
    out = (g.join(nw, keys).withColumn("n_eff", n_eff).withColumn("ir", F.col("mean_ic") / F.when(F.col("sd") > 0, F.col("sd")))
           .withColumn("t_nw", F.when(F.col("n_eff") >= min_eff, F.col("t_nw"))))
    return out.withColumn("p_value", F.when(F.col("t_nw").isNotNull(), student_t_p("t_nw", F.greatest(F.col("n_eff") - 1, F.lit(1.0)))))


def ic_decay(summary: DataFrame, keys: list[str], days: str, ic: str = "mean_ic") -> DataFrame:
    """Half-life of an exponential decay fitted to the positive mean ICs over the horizons."""
    pos = F.when(F.col(ic) > 0, F.col(ic))
    y, x = F.log(pos), F.when(pos.isNotNull(), F.col(days).cast("double"))
    g = summary.groupBy(*keys).agg(F.count(pos).alias("n_points"), F.regr_slope(y, x).alias("_s"), F.regr_intercept(y, x).alias("_i"))
    falling = (F.col("n_points") >= 2) & (F.col("_s") < 0)
    return g.select(*keys, "n_points", F.when(falling, math.log(2) / -F.col("_s")).alias("half_life"),
                    F.when(falling, F.exp("_i")).alias("ic_zero"), F.when(falling, -F.col("_s")).alias("decay_rate"))


def power_weeks(ics: DataFrame, factor: str, effect: float = 0.05) -> DataFrame:
    """Weeks of data needed to detect an IC of ``effect``, from the median IC deviation."""
    sd = ics.filter("ic is not null").groupBy(factor).agg(F.stddev_samp("ic").alias("sd"), F.count("*").alias("n")).filter("n > 2")
    return sd.agg(F.percentile("sd", 0.5).alias("sd")).select(
        "sd", F.ceil(F.pow(POWER_Z * F.col("sd") / effect, F.lit(2.0))).alias("weeks"))


def _sharpes(x: np.ndarray, start: np.ndarray, block: int) -> np.ndarray:
    """Yearly Sharpe ratio of each row of block starts over a circular series; NaN without spread."""
    m, mid = len(x), np.median(x)
    d = x - mid  # sums around the middle keep their digits, and a constant series is exactly zero
    s = q = 0.0
    for starts, length in ((start[:, :-1], block), (start[:, -1:], m % block)):
        at = (np.arange(m)[:, None] + np.arange(length)) % m
        s = s + d[at].sum(axis=1)[starts].sum(axis=1)
        q = q + (d[at] ** 2).sum(axis=1)[starts].sum(axis=1)
    spread = q - s * s / m
    spread = np.where(spread <= 1e-13 * q, np.nan, spread)
    return (mid + s / m) / np.sqrt(spread / (m - 1)) * math.sqrt(12)


def _resampled(block: int, reps: int):
    """UDF over one series a row: percentiles of the Sharpe difference of its replications."""
    @F.pandas_udf("struct<lo double, hi double>")
    def bounds(stem: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out, tails = np.full((len(stem), 2), np.nan), {}
        for row, (text, x, y) in enumerate(zip(stem, a, b, strict=True)):
            m = len(x)
            if m < 2:
                continue
            blocks = m // block + 1
            if blocks not in tails:
                tails[blocks] = [b"|%d|%d" % (r, k) for r in range(1, reps + 1) for k in range(blocks)]
            head = text.encode()
            digests = b"".join([md5(head + tail, usedforsecurity=False).digest()[:8] for tail in tails[blocks]])
            start = (np.frombuffer(digests, ">u8") >> np.uint64(4)).astype(np.int64) % m
            start = start.reshape(reps, blocks)
            diff = _sharpes(np.asarray(x, float), start, block) - _sharpes(np.asarray(y, float), start, block)
            diff = diff[~np.isnan(diff)]
            if len(diff):
                out[row] = np.percentile(diff, (2.5, 97.5))
        return pd.DataFrame(out, columns=["lo", "hi"])

    return bounds


def block_bootstrap_sharpe_diff(df: DataFrame, keys: list[str], a: str, b: str, order: str, block: int = 6, reps: int = 2000,
                                seed: int = 0) -> DataFrame:
    """2.5 and 97.5 percentiles of the Sharpe difference under a circular block bootstrap.

    Each replication draws block starts from the md5 of (seed, keys, replication, block), which other engines have too.
    A series is one row with two arrays, bounded by the calendar; its replications are drawn and summed up within the
    row, so that no draw is ever a row of its own. Series are dealt out by key to a fixed number of tasks, as their work is
    far larger than their bytes.
    """
    spark = df.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    there = F.col(a).isNotNull() & F.col(b).isNotNull()
    for k in keys:
        there = there & F.col(k).isNotNull()
    rows = df.filter(there).select(*keys, F.struct(F.col(order).alias("o"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).alias("_v"))
    one = rows.repartition(tasks, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias("_v"))
    stem = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys])
    out = one.select(*keys, _resampled(block, reps)(stem, F.col("_v.a"), F.col("_v.b")).alias("_d"))
    return out.select(*keys, *[F.nanvl(F.col(f"_d.{c}"), F.lit(None).cast("double")).alias(c) for c in ("lo", "hi")], F.lit(reps).cast("long").alias("reps"))


def nav_metrics(df: DataFrame, keys: list[str], order: str, trials=(4, 10, 20), min_n: int = 60) -> DataFrame:
    """Yearly return and volatility, Sharpe over the rate, drawdown, PSR and deflated Sharpe.

    ``df``: keys, order, nav, rate (return of the rate over the same step).
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rows = (df.withColumn("_r", F.col("nav") / F.lag("nav").over(w) - 1)
            .withColumn("_dd", F.col("nav") / F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
            .withColumn("_e", F.col("_r") - F.col("rate")))
    g = rows.groupBy(*keys).agg(F.min_by("nav", order).alias("first"), F.max_by("nav", order).alias("last"), F.count("_r").alias("n_days"),
                                F.stddev_samp("_r").alias("_sd"), F.min("_dd").alias("max_drawdown"))
    m = series_moments(rows, keys, "_e")
    skew, kurt = unbiased_shape()
    m = m.withColumn("skew", skew).withColumn("kurt", kurt).select(*keys, "n", "mean", "std", "skew", "kurt")
    j = g.join(m, keys).filter(F.col("n_days") >= min_n)
    live = F.col("std") >= 1e-8
    sr = F.when(live, F.col("mean") / F.col("std"))
    j = (j.withColumn("ann_return", F.pow(F.col("last") / F.col("first"), 252 / F.col("n_days")) - 1)
         .withColumn("ann_vol", F.col("_sd") * math.sqrt(252)).withColumn("total_return", F.col("last") / F.col("first") - 1)
         .withColumn("sr", sr).withColumn("sharpe", F.col("sr") * math.sqrt(252)))
    j = j.withColumn("psr", probabilistic_sharpe(F.col("sr"), F.col("n"), F.col("skew"), F.col("kurt"), floor=None))
    for k in trials:
        best = expected_max_sharpe(k, 1 / (F.col("n") - 1))
        j = j.withColumn(f"dsr_{k}", probabilistic_sharpe(F.col("sr"), F.col("n"), F.col("skew"), F.col("kurt"), best, floor=None))
    return j.drop("first", "last", "_sd", "mean", "std", "skew", "kurt", "n", "sr")
