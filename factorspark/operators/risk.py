"""Factor risk model: style and sector factor returns, exposures, decomposition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorspark.operators import xsection as X

STYLE_ORDER = ("MKT", "SMB", "HML", "UMD")
MIN_OBS, MIN_OBS_NAME, MIN_LEG = 30, 20, 6
#: Sessions that the model looks back.
LOOKBACK = 252


def winsorized_returns(rets: DataFrame, k: float = 3.0) -> DataFrame:
    """Log returns cut at ±k deviations of their own security; ``rets``: sid, date, r."""
    sd = rets.groupBy("sid").agg((F.stddev_samp("r") * k).alias("_b"))
    return rets.join(sd, "sid").withColumn("r", F.greatest(-F.col("_b"), F.least(F.col("_b"), F.col("r")))).drop("_b")


def tercile_legs(chars: DataFrame, name: str, value: str, low_is_long: bool) -> DataFrame:
    """Bottom and top third by a characteristic as a signed leg (+1 long, -1 short)."""
    r = X.with_first_rank(chars.withColumn("_k", F.lit(1)).filter(F.col(value).isNotNull()), ["_k"], value, "sid", "_r", "_n")
    cut = F.floor(F.col("_n") / 3)
    bottom, top = F.col("_r") <= cut, F.col("_r") > F.col("_n") - cut
    sign = 1 if low_is_long else -1
    leg = F.when(bottom, sign).when(top, -sign)
    return r.filter(F.col("_n") >= MIN_LEG).select("sid", F.lit(name).alias("factor"), leg.alias("leg")).filter("leg is not null")


def factor_returns(rets: DataFrame, market: DataFrame, chars: DataFrame) -> DataFrame:
    """Daily factor returns as rows (date, factor, f): market, dollar-neutral styles, sector spreads.

    ``chars``: sid, sector, market_cap, earnings_yield, alpha_6m. The first sector is the baseline.
    """
    legs = (tercile_legs(chars, "SMB", "market_cap", True).unionByName(tercile_legs(chars, "HML", "earnings_yield", False))
            .unionByName(tercile_legs(chars, "UMD", "alpha_6m", False)))
    side = rets.join(legs, "sid").groupBy("date", "factor").agg(
        F.avg(F.when(F.col("leg") == 1, F.col("r"))).alias("_l"), F.avg(F.when(F.col("leg") == -1, F.col("r"))).alias("_s"))
    styles = side.select("date", "factor", (F.col("_l") - F.col("_s")).alias("f")).filter("f is not null")
    sized = chars.groupBy("sector").agg(F.count("*").alias("_c")).filter("_c >= 2").drop("_c")
    base = sized.agg(F.min("sector").alias("_base"))
    universe = rets.groupBy("date").agg(F.avg("r").alias("_u"))
    sect = (rets.join(chars.select("sid", "sector"), "sid").join(sized, "sector").groupBy("date", "sector").agg(F.avg("r").alias("_m"))
            .join(universe, "date").join(F.broadcast(base)).filter("sector <> _base")
            .select("date", F.concat(F.lit("SEC_"), "sector").alias("factor"), (F.col("_m") - F.col("_u")).alias("f")))
    mkt = market.select("date", F.lit("MKT").alias("factor"), F.col("m").alias("f"))
    return mkt.unionByName(styles).unionByName(sect)


def lookback(rets: DataFrame, market: DataFrame, sessions: int = LOOKBACK) -> tuple[DataFrame, DataFrame]:
    """Both inputs on the dates that are among the last ``sessions`` of either; no row below ``MIN_OBS`` such dates."""
    def last(df: DataFrame) -> DataFrame:
        return df.select("date").distinct().orderBy(F.desc("date")).limit(sessions)

    dates = last(rets).join(last(market), "date")
    enough = dates.groupBy().agg(F.collect_list("date").alias("_d")).filter(F.size("_d") >= MIN_OBS).select(F.explode("_d").alias("date"))
    return rets.join(enough, "date", "left_semi"), market.join(enough, "date", "left_semi")


def _days(factors: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each date that has every factor: ``v``, its values as (place, factor, f) in fixed order."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STYLE_ORDER)), F.col("factor")), F.lit(0)), F.lit(len(STYLE_ORDER) + 1))
    v = F.sort_array(F.collect_list(F.struct(place.alias("place"), "factor", "f")))
    day = factors.filter("f is not null").groupBy(*keys, "date").agg(v.alias("v"))
    # dates are at most a calendar, so one window over them is small
    return day.withColumn("_most", F.max(F.size("v")).over(Window.partitionBy(*(keys or [F.lit(0)])))).filter(F.size("v") == F.col("_most")).drop("_most")


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means and the covariances of the upper triangle, in order, of the arrays ``x``: sums that combine map-side."""
    pairs = rows.select(*keys, F.posexplode("x").alias("i", "a"), "x").select(*keys, "i", "a", F.posexplode("x").alias("j", "b")).filter("j >= i")
    cells = pairs.groupBy(*keys, "i", "j").agg(F.covar_samp("a", "b").alias("c"), F.avg("a").alias("m"), F.count("*").alias("n"))
    row = F.sort_array(F.collect_list(F.struct("i", "j", "c", "m")))  # as many as pairs of factors
    return cells.groupBy(*keys).agg(row.alias("_row"), F.first("n").alias("n")).select(
        *keys, "n", F.col("_row.c").alias("cov"), F.expr("transform(filter(_row, r -> r.i = r.j), r -> r.m)").alias("mean"))


def _square(cov: pd.Series, width: int) -> np.ndarray:
    """Symmetric matrices from upper triangles."""
    out = np.zeros((len(cov), width, width))
    i, j = np.triu_indices(width)
    flat = np.stack(cov.to_numpy()).astype(float)
    out[:, i, j] = flat
    out[:, j, i] = flat
    return out


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _residual_rows(cov: pd.Series, width: pd.Series) -> pd.Series:
    """Rows of weights that turn centred factors into their residuals on those before: the inverse of the unit Cholesky factor."""
    out = []
    for flat, k in zip(cov, width, strict=True):
        left, rows = _square(pd.Series([flat]), k)[0], np.eye(k)
        for j in range(k - 1):
            if left[j, j] > 0:
                part = left[:, j] / left[j, j]
                part[: j + 1] = 0
                left = left - np.outer(part, left[j])
                rows = rows - np.outer(part, rows[j])
        out.append(rows.tolist())
    return pd.Series(out)


def orthogonalize(factors: DataFrame, as_of: str | None = None) -> DataFrame:
    """Each factor's residual on the ones before it (market, styles, then sectors by name).

    Only dates with every factor take part. The covariances of all factors decide the projections, so they are aggregated
    first; one row of weights per as-of date then goes back to the dates.
    """
    keys = [as_of] if as_of else []
    day = _days(factors, keys).withColumn("x", F.col("v.f"))
    m = _moments(day, keys).withColumn("w", _residual_rows("cov", F.size("mean"))).select(*keys, "mean", "w")
    day = day.join(F.broadcast(m), keys) if keys else day.crossJoin(F.broadcast(m))  # one row
    centred = F.zip_with("x", "mean", lambda x, y: x - y)
    day = day.withColumn("_c", centred)
    value = F.transform("w", lambda row, k: F.when(k == 0, F.element_at("x", 1)).otherwise(
        F.aggregate(F.zip_with(row, F.col("_c"), lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)))
    rows = F.arrays_zip(F.col("v.factor").alias("factor"), value.alias("f"))
    return day.select(*keys, "date", F.explode(rows).alias("r")).select(*keys, "date", F.col("r.factor").alias("factor"), F.col("r.f").alias("f"))


@F.pandas_udf(T.StructType([T.StructField("beta", T.ArrayType(T.DoubleType())), *[T.StructField(c, T.DoubleType()) for c in ("alpha", "specific", "r2")]]))
def _fit(cov: pd.Series, mean: pd.Series, width: pd.Series) -> pd.DataFrame:
    """Least squares of the last variable on the others, for all rows of equal width at once."""
    out = pd.DataFrame({"beta": [[]] * len(cov), "alpha": np.nan, "specific": np.nan, "r2": 0.0})
    for k in width.unique():
        at = np.flatnonzero(width == k)
        c, mu = _square(cov.iloc[at], k), np.stack(mean.iloc[at].to_numpy()).astype(float)
        beta = (np.linalg.pinv(c[:, :-1, :-1], hermitian=True) @ c[:, :-1, -1:])[:, :, 0]
        total, explained = c[:, -1, -1], (beta * c[:, :-1, -1]).sum(axis=1)
        for i, b in zip(at, beta.tolist(), strict=True):
            out.at[i, "beta"] = b
        out.loc[at, "alpha"] = mu[:, -1] - (beta * mu[:, :-1]).sum(axis=1)
        out.loc[at, "specific"] = np.sqrt(np.maximum(total - explained, 0) * 252)
        out.loc[at, "r2"] = np.maximum(0, np.divide(explained, total, out=np.zeros(len(at)), where=total > 0))
    return out


def exposures(rets: DataFrame, factors: DataFrame) -> DataFrame:
    """Least squares of every security's returns on the factors: (sid, factor, beta, specific, r2).

    Products of a day's return and factors are summed by security before they are exchanged; what is left is a small system for
    each security. Ids may have any type. Securities with less than ``MIN_OBS_NAME`` returns are left out.
    """
    day = _days(factors, [])
    rows = rets.filter("r is not null").join(day, "date").select("sid", F.concat(F.col("v.f"), F.array("r")).alias("x"))
    names = day.agg(F.first("v.factor").alias("names"))
    m = _moments(rows, ["sid"]).filter(F.col("n") >= MIN_OBS_NAME).withColumn("fit", _fit("cov", "mean", F.size("mean")))
    m = m.crossJoin(F.broadcast(names))  # one row
    cells = F.arrays_zip(F.concat(F.array(F.lit("alpha")), "names").alias("factor"), F.concat(F.array("fit.alpha"), "fit.beta").alias("beta"))
    return m.select("sid", F.explode(cells).alias("e"), "fit.specific", "fit.r2").select("sid", F.col("e.factor").alias("factor"), F.col("e.beta").alias("beta"), "specific", "r2")


def factor_cov(factors: DataFrame) -> DataFrame:
    """Yearly covariance of every factor pair. Factors of one date meet in an array of about a
    dozen entries, exploded twice; the pairs aggregate map-side."""
    day = factors.groupBy("date").agg(F.collect_list(F.struct("factor", "f")).alias("v"))
    pairs = day.select(F.explode("v").alias("a"), "v").select("a", F.explode("v").alias("b"))
    return pairs.groupBy(F.col("a.factor").alias("f1"), F.col("b.factor").alias("f2")).agg(
        (F.covar_samp(F.col("a.f"), F.col("b.f")) * 252).alias("cov"))


def risk_decomposition(weights: DataFrame, expo: DataFrame, cov: DataFrame, keys: list[str]) -> DataFrame:
    """Total, factor and specific volatility and each factor's contribution to the variance.

    ``weights``: keys, sid, w, renormalised over the securities with exposures.
    """
    e = expo.filter("factor <> 'alpha'")
    have = expo.select("sid", "specific").distinct()
    held = weights.join(have, "sid")
    tot = held.groupBy(*keys).agg(F.sum("w").alias("_t"))
    held = held.join(tot, keys).withColumn("w", F.col("w") / F.col("_t")).drop("_t")
    spec = held.groupBy(*keys).agg(F.sum(F.col("w") * F.col("w") * F.col("specific") * F.col("specific")).alias("specific_var"))
    b = held.join(e.select("sid", "factor", "beta"), "sid").groupBy(*keys, "factor").agg(F.sum(F.col("w") * F.col("beta")).alias("b"))
    inner = (b.withColumnRenamed("factor", "f2").join(cov, "f2").groupBy(*keys, F.col("f1").alias("factor"))
             .agg(F.sum(F.col("cov") * F.col("b")).alias("_m")))
    part = b.join(inner, [*keys, "factor"]).withColumn("contribution", F.col("b") * F.col("_m"))
    var = part.groupBy(*keys).agg(F.sum("contribution").alias("factor_var")).join(spec, keys)
    fv, sv = F.greatest(F.col("factor_var"), F.lit(0.0)), F.col("specific_var")
    var = (var.withColumn("factor_vol", F.sqrt(fv)).withColumn("specific_vol", F.sqrt(sv))
           .withColumn("total_vol", F.sqrt(F.col("factor_var") + sv)).withColumn("factor_pct", F.col("factor_var") / (F.col("factor_var") + sv)))
    return part.drop("_m").join(var.drop("factor_var", "specific_var"), keys)
