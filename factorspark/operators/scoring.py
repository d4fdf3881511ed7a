"""Live scores: factor normalisation, pillars, total, trace, conviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorspark.functions.scalars import liquidity_penalty
from factorspark.operators import xsection as X

# Factor, base weight, +1 higher is better / -1 lower is better.
FUNDAMENTAL = {"earnings_yield": (0.20, 1), "pvp": (0.15, -1), "roe": (0.25, 1), "roic": (0.20, 1),
               "debt_ebitda": (0.10, -1), "dividend_yield": (0.10, 1), "log_market_cap": (0.05, -1),
               "revenue_growth_3y": (0.04, 1), "earnings_growth_3y": (0.04, 1), "asset_growth": (0.05, -1)}
MOMENTUM = {"alpha_3m": (0.30, 1), "alpha_12m": (0.30, 1), "analyst_score": (0.10, 1), "target_upside": (0.05, 1),
            "pead_signal": (0.10, 1)}
QUALITY = {"volatility": (0.40, -1), "beta": (0.35, -1), "adv": (0.25, 1)}
PILLARS = {"fundamental": 0.45, "momentum": 0.30, "quality": 0.25}
REGIME_PILLARS = {"risk_on": {"fundamental": 0.30, "momentum": 0.50, "quality": 0.20},
                  "mean_rev": {"fundamental": 0.50, "momentum": 0.20, "quality": 0.30},
                  "bear": {"fundamental": 0.30, "momentum": 0.10, "quality": 0.60}}
FCF_PAYOUT_LIMIT, EY_PAYOUT_LIMIT = 1.2, 1.5
CONVICTION_HIGH, CONVICTION_MEDIUM = 0.66, 0.40


def to_long(df: DataFrame, ids: list[str], factors: dict) -> DataFrame:
    """Wide factors to rows (ids, factor, value, weight, direction)."""
    present = [f for f in factors if f in df.columns]
    wide = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in present])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("value"), F.lit(factors[f][0]).alias("weight"),
                                        F.lit(float(factors[f][1])).alias("direction")) for f in present]))
    return wide.select(*ids, rows.alias("r")).select(*ids, "r.*")


def normalized(df: DataFrame, keys: list[str], factors: dict, sector: str | None = None) -> DataFrame:
    """Score of every factor; within sectors when ``sector`` names the column."""
    ids = [*keys, "sid"] + ([sector] if sector else [])
    long = to_long(df, ids, factors).withColumn("signed", F.col("value") * F.col("direction"))
    if sector:
        return X.normalize_adaptive(long, [*keys, "factor"], sector, "signed")
    return X.normalize_global(long, [*keys, "factor"], "signed")


def weighted_score(long: DataFrame, keys: list[str], out: str, active: Column | None = None) -> DataFrame:
    """Weighted mean of the available factor scores per security, weights renormalised, within 0..100."""
    use = F.col("score").isNotNull() if active is None else F.col("score").isNotNull() & active
    s = F.sum(F.when(use, F.col("weight") * F.col("score"))) / F.sum(F.when(use, F.col("weight")))
    return long.groupBy(*keys, "sid").agg(s.alias(out)).withColumn(
        out, F.when(F.col(out).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(out)))))


def fundamental_active(financial: Column) -> Column:
    """Which factor counts for a security: no ROIC for financials; no dividend yield when it is
    not covered by free cash flow, or is far above the earnings yield."""
    not_roic = (F.col("factor") == "roic") & financial
    unpaid = F.coalesce(F.col("fcf_payout") > FCF_PAYOUT_LIMIT, F.lit(False))
    stretched = F.coalesce((F.col("earnings_yield") > 0) & (F.col("dividend_yield") > 0)
                           & (F.col("dividend_yield") / F.col("earnings_yield") > EY_PAYOUT_LIMIT), F.lit(False))
    not_dy = (F.col("factor") == "dividend_yield") & (unpaid | stretched)
    return ~(not_roic | not_dy)


def score_fundamental(df: DataFrame, keys: list[str], financial: Column) -> tuple[DataFrame, DataFrame]:
    """(scores, long trace). ``df`` carries sector, the factors and fcf_payout."""
    long = normalized(df, keys, FUNDAMENTAL, "sector")
    rules = df.select(*keys, "sid", "fcf_payout", "earnings_yield", "dividend_yield", financial.alias("_fin"))
    ruled = long.join(rules, [*keys, "sid"])
    return weighted_score(ruled, keys, "fundamental_score", fundamental_active(F.col("_fin"))), long


def score_momentum(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    long = normalized(df, keys, MOMENTUM)
    return weighted_score(long, keys, "momentum_score"), long


def score_quality(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    long = normalized(df, keys, QUALITY)
    return weighted_score(long, keys, "quality_score"), long


def total_score(df: DataFrame, regime: Column | None = None) -> DataFrame:
    """Pillars to the total, times the liquidity penalty; pillar weights may follow the regime."""
    def weight(pillar):
        if regime is None:
            return F.lit(PILLARS[pillar])
        expr = F
        for name, w in REGIME_PILLARS.items():
            expr = expr.when(regime == name, F.lit(w[pillar]))
        return expr.otherwise(PILLARS[pillar])

    raw = sum(weight(p) * F.col(f"{p}_score") for p in PILLARS)
    return df.withColumn("liquidity_penalty", liquidity_penalty(F.col("adv"))).withColumn(
        "total_score", F.round(raw * F.col("liquidity_penalty"), 2))


def trace_map(long: DataFrame, keys: list[str]) -> DataFrame:
    """Normalisation trace of each security as a map factor -> details (bounded by the factor list)."""
    detail = F.struct("method", "n_peers", "score", "z", "pct", "direction")
    return long.groupBy(*keys, "sid").agg(F.map_from_entries(F.collect_list(F.struct("factor", detail))).alias("norm_details"))


def dominant_method(long: DataFrame, keys: list[str]) -> DataFrame:
    """Strongest method among a security's fundamental factors."""
    def any_of(m):
        return F.bool_or(F.col("method") == m)

    return long.groupBy(*keys, "sid").agg(
        F.when(any_of("zscore_sectoral"), "zscore_sectoral").when(any_of("percentile_sectoral"), "percentile_sectoral")
        .when(any_of("zscore_global"), "zscore_global").otherwise("unknown").alias("method"))


def conviction(long: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """How well the inputs support a score: coverage, peers, method, margin above 50."""
    g = long.groupBy(*keys, "sid").agg((F.count("score") / F.count("*")).alias("coverage"), F.max("n_peers").alias("peers"))
    df = scored.select(*keys, "sid", "total_score").join(g, [*keys, "sid"]).join(dominant_method(long, keys), [*keys, "sid"])
    peers = F.when(F.col("peers") >= 8, 1.0).when(F.col("peers") >= 4, 0.6).otherwise(0.3)
    method = F.when(F.col("method") == "zscore_sectoral", 1.0).when(F.col("method") == "percentile_sectoral", 0.7).otherwise(0.4)
    margin = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("total_score") - 50) / 50)), F.lit(0.0))
    margin = F.when(F.col("total_score").isNull(), 0.0).otherwise(margin)
    c = F.round(0.35 * F.col("coverage") + 0.25 * peers + 0.20 * method + 0.20 * margin, 3)
    return df.withColumn("conviction", c).withColumn(
        "label", F.when(F.col("conviction") >= CONVICTION_HIGH, "Alta").when(F.col("conviction") >= CONVICTION_MEDIUM, "Média").otherwise("Baixa"))


def explain(long: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """The factors farthest from neutral, strongest first. One security has at most one row per factor."""
    e = F.struct((-F.abs(F.col("score") - 50)).alias("k"), F.col("factor"), F.col("score"))
    g = long.filter("score is not null").groupBy(*keys, "sid").agg(F.slice(F.array_sort(F.collect_list(e)), 1, n).alias("top"))
    return (g.select(*keys, "sid", F.posexplode("top").alias("pos", "e"))
            .select(*keys, "sid", (F.col("pos") + 1).alias("position"), "e.factor", "e.score"))


def metric_coverage(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Share of rows with a value, one row per metric."""
    wide = df.agg(*[F.avg(F.col(m).isNotNull().cast("double")).alias(m) for m in metrics])
    return wide.unpivot([], metrics, "metric", "coverage")


def coverage_report(declared: DataFrame, priced: DataFrame, funded: DataFrame, scored: DataFrame) -> DataFrame:
    """Declared, collected and scored securities with the reason each missing one was lost.

    All inputs hold one ``sid`` per row. Returns one row per declared security.
    """
    def flag(df, name):
        return df.select("sid").distinct().withColumn(name, F.lit(True))

    j = (declared.select("sid").distinct().join(flag(priced, "_p"), "sid", "left").join(flag(funded, "_f"), "sid", "left")
         .join(flag(scored, "_s"), "sid", "left"))
    p, f, s = (F.coalesce(c, F.lit(False)) for c in ("_p", "_f", "_s"))
    reason = F.when(~p, "no_price_history").when(~f, "no_fundamentals").when(~s, "filtered_out")
    return j.select("sid", (p & f).alias("collected"), s.alias("scored"), reason.alias("missing"))
