"""Technical indicators at the last session of each security, signals, alerts, scan, levels.

The price history of a security is read once: one window pass numbers the rows, one aggregate
per security (bounded by the number of sessions) yields every indicator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.operators import timeseries as ts

PERIOD = 14
KEEP = 1 - 1 / PERIOD
STOP_NEAR = 0.02


def _wilder(x: Column, k: Column, m: Column) -> Column:
    """Wilder average after the last of ``m`` changes, change number ``k`` being ``x``.

    The recurrence (a·13 + x)/14 seeded with the mean of 14 unrolls to a weighted sum whose
    weights only shrink with age, so it needs no loop and cannot overflow.
    """
    weight = F.pow(F.lit(KEEP), (m - F.greatest(k, F.lit(PERIOD))).cast("double")) / PERIOD
    return F.sum(F.when(k >= 1, x * weight))


def _ema(x: Column, i: Column, age: Column, span: int, signal: int | None = None) -> Column:
    """Exponential average of ``x`` at the row of age 0; with ``signal`` the average over that span of its course.

    The recurrence seeded with row number 1 unrolls to a sum with weights a·p^age, without the a for the seed. An average of averages
    convolves two geometric series, which is a difference of powers. Rows after age 0 (negative ages) don't count.
    """
    a = 2.0 / (span + 1)
    p = F.lit(1 - a)
    if signal is None:
        weight = F.pow(p, age.cast("double"))
    else:
        b = 2.0 / (signal + 1)
        weight = (F.pow(p, (age + 1).cast("double")) - F.pow(F.lit(1 - b), (age + 1).cast("double"))) * (b / (b - a))
    return F.sum(F.when(age >= 0, x * F.when(i == 1, weight).otherwise(a * weight)))


def _macd(x: Column, i: Column, age: Column, fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
    """Fast and slow average, signal line and histogram at the last row, and the histogram one row before.

    ``x``: closes less the last one, so that a constant series gives zeros.
    """
    f, w = _ema(x, i, age, fast), _ema(x, i, age, slow)
    g = _ema(x, i, age, fast, signal) - _ema(x, i, age, slow, signal)
    before = age - 1
    pg = _ema(x, i, before, fast, signal) - _ema(x, i, before, slow, signal)
    ph = _ema(x, i, before, fast) - _ema(x, i, before, slow) - pg
    return F.struct(f.alias("f"), w.alias("w"), g.alias("g"), ph.alias("ph"), (f - w - g).alias("h"))


def technical_panel(bars: DataFrame, key: str = "sid") -> DataFrame:
    """All indicators per security; ``bars``: key, date, open, close, volume with one row per session."""
    w = ts.by_row(key)
    whole = Window.partitionBy(key)
    df = (bars.filter("close is not null").withColumn("i", F.row_number().over(w))
          .withColumn("n", F.count("*").over(whole)).withColumn("last", F.max_by("close", "date").over(whole)).withColumn("d", F.col("close") - F.lag("close").over(w))
          .withColumn("j", F.col("n") - F.col("i") + 1))
    j, k, m, d = F.col("j"), F.col("i") - 1, F.col("n") - 1, F.col("d")

    def at(col, row):
        return F.max(F.when(j == row, F.col(col)))

    def last(n, col="close"):
        return F.when(j <= n, F.col(col))

    agg = df.groupBy(key).agg(
        F.count("*").alias("n"), F.max("date").alias("date"), at("close", 1).alias("price"),
        at("close", 2).alias("price_prev"), at("open", 1).alias("last_open"), at("volume", 1).alias("last_volume"),
        F.avg(F.when(j.between(2, 5), F.col("volume"))).alias("avg_volume"),
        *[F.avg(last(n)).alias(f"ma{n}") for n in (20, 50, 200)],
        F.stddev_pop(last(20)).alias("sd20"), F.max(last(252)).alias("high_52w"), F.min(last(252)).alias("low_52w"),
        _wilder(F.greatest(d, F.lit(0.0)), k, m).alias("gain"), _wilder(F.greatest(-d, F.lit(0.0)), k, m).alias("loss"),
        _wilder(F.abs(d), k, m).alias("atr"),
        _macd(F.col("close") - F.col("last"), F.col("i"), j - 1).alias("macd"))
    n, price = F.col("n"), F.col("price")
    enough = n >= 30
    agg = agg.withColumn("macd", F.when(n >= 35, F.col("macd"))).filter(enough)
    for k_ in (20, 50, 200):
        agg = agg.withColumn(f"ma{k_}", F.when(n >= k_, F.col(f"ma{k_}")))
    up, lo = F.col("ma20") + 2 * F.col("sd20"), F.col("ma20") - 2 * F.col("sd20")
    pos = F.when(up > lo, (price - lo) / (up - lo)).otherwise(0.5)
    rsi = F.when(F.col("loss") == 0, F.when(F.col("gain") > 0, 100.0).otherwise(50.0)).otherwise(
        100 - 100 / (1 + F.col("gain") / F.col("loss")))
    line = F.col("macd.f") - F.col("macd.w")
    h, ph = F.col("macd.h"), F.col("macd.ph")
    out = (agg.withColumn("change_1d", (price - F.col("price_prev")) / F.col("price_prev"))
           .withColumn("rsi", rsi).withColumn("ema_fast", price + F.col("macd.f")).withColumn("ema_slow", price + F.col("macd.w"))
           .withColumn("macd_line", line).withColumn("macd_signal", F.col("macd.g"))
           .withColumn("macd_hist", h)
           .withColumn("macd_cross", F.when((ph < 0) & (h >= 0), "bullish").when((ph > 0) & (h <= 0), "bearish"))
           .withColumn("macd_above", F.coalesce(line > F.col("macd.g"), F.lit(False)))
           .withColumn("bb_upper", up).withColumn("bb_lower", lo)
           .withColumn("bb_position", F.greatest(F.lit(-0.2), F.least(F.lit(1.2), pos)))
           .withColumn("bb_width", (up - lo) / F.col("ma20"))
           .withColumn("atr_pct", F.col("atr") / price)
           .withColumn("from_high", price / F.col("high_52w") - 1).withColumn("from_low", price / F.col("low_52w") - 1)
           .withColumn("gap", F.col("last_open") / F.col("price_prev") - 1)
           .withColumn("volume_ratio", F.col("last_volume") / F.when(F.col("avg_volume") > 0, F.col("avg_volume"))))
    out = (out.withColumn("near_high", F.abs(F.col("from_high")) < 0.03).withColumn("near_low", F.col("from_low") < 0.05)
           .drop("macd", "sd20", "gain", "loss"))
    return out.withColumn("trend", trend_label()).withColumn("signal", technical_signal())


def trend_label() -> Column:
    p, a, b, c = (F.col(x) for x in ("price", "ma20", "ma50", "ma200"))
    return (F.when((p > a) & (a > b) & (b > c), "uptrend")
            .when(c.isNotNull() & (p < a) & (a < b), "downtrend")
            .when((p > a) & (p > b), "uptrend").when((p < a) & (p < b), "downtrend").otherwise("sideways"))


def technical_signal() -> Column:
    """Sum of indicator votes mapped to five labels."""
    rsi, p, bb = F.col("rsi"), F.col("price"), F.col("bb_position")

    def vote(*cases):
        expr = F
        for cond, points in cases:
            expr = expr.when(cond, F.lit(points))
        return expr.otherwise(0.0)

    score = vote((rsi < 30, 1.0), (rsi < 45, 0.4), (rsi > 70, -1.0), (rsi > 55, -0.4))
    for col, points in (("ma20", 0.5), ("ma50", 0.5), ("ma200", 0.25)):
        score = score + vote((p > F.col(col), points), (F.col(col).isNotNull(), -points))
    score = score + vote((F.col("macd_above"), 0.4), (F.lit(True), -0.4))
    score = score + vote((F.col("macd_cross") == "bullish", 0.5), (F.col("macd_cross") == "bearish", -0.5))
    score = score + vote((bb < 0.15, 0.5), (bb > 0.85, -0.5))
    score = F.round(score, 6)
    return (F.when(score > 1.5, "strong_buy").when(score > 0.5, "buy").when(score < -1.5, "strong_sell")
            .when(score < -0.5, "sell").otherwise("neutral"))


def technical_alerts(panel: DataFrame, key: str = "sid") -> DataFrame:
    """One row per notable event of a security."""
    def alert(cond, kind, value):
        return F.when(cond, F.struct(F.lit(kind).alias("type"), value.cast("double").alias("value")))

    c = F.col
    events = F.array_compact(F.array(
        alert(c("gap") > 0.02, "gap_up", c("gap")), alert(c("gap") < -0.02, "gap_down", c("gap")),
        alert(c("volume_ratio") >= 2.0, "volume_spike", c("volume_ratio")),
        alert(c("near_high"), "near_52w_high", c("from_high")), alert(c("near_low"), "near_52w_low", c("from_low")),
        alert(c("macd_cross") == "bullish", "macd_bullish", F.lit(None)),
        alert(c("macd_cross") == "bearish", "macd_bearish", F.lit(None)),
        alert(c("rsi") < 30, "oversold", c("rsi")), alert(c("rsi") > 70, "overbought", c("rsi"))))
    return panel.select(key, F.explode(events).alias("a")).select(key, "a.type", "a.value")


def scan_criteria(df: DataFrame, min_score: float = 72.0, rsi_range=(28.0, 48.0), min_volume: float = 1.5,
                  max_bb: float = 0.35, min_secondary: int = 2) -> DataFrame:
    """Scanner criteria per security: four primary, three secondary, qualified and near miss."""
    c = F.col

    def hit(cond):
        return F.coalesce(cond, F.lit(False))

    primary = {"p_score": hit(c("total_score") >= min_score), "p_signal": hit(c("signal").isin("buy", "strong_buy")),
               "p_rsi": hit(c("rsi").between(*rsi_range)), "p_macd": hit(c("macd_above"))}
    secondary = {"s_cross": hit(c("macd_cross") == "bullish"), "s_volume": hit(c("volume_ratio") >= min_volume),
                 "s_bb": hit(c("bb_position") <= max_bb)}
    for name, cond in {**primary, **secondary}.items():
        df = df.withColumn(name, cond)
    df = (df.withColumn("primary_hits", sum(c(n).cast("int") for n in primary))
            .withColumn("secondary_hits", sum(c(n).cast("int") for n in secondary)))
    df = df.withColumn("qualified", (c("primary_hits") == 4) & (c("secondary_hits") >= min_secondary))
    return df.withColumn("near_miss", ~c("qualified") & ((c("primary_hits") == 3) | (c("primary_hits") == 4)))


def scan_targets(price: Column, min_gap: float = 0.015) -> Column:
    """The two nearest resistances above the price, extended or fixed where there are fewer."""
    levels = F.array_sort(F.filter(F.array(*[F.col(x) for x in ("ma20", "ma50", "ma200", "high_52w")]),
                                   lambda x: x.isNotNull() & (x > price * (1 + min_gap))))
    levels = F.transform(levels, lambda x: F.round(x, 2))
    return (F.when(F.size(levels) == 0, F.array(F.round(price * 1.10, 2), F.round(price * 1.20, 2)))
            .when(F.size(levels) == 1, F.array(levels[0], F.round(levels[0] * 1.08, 2)))
            .otherwise(F.slice(levels, 1, 2)))


def scan_risk(vol: Column, beta: Column) -> Column:
    v = F.coalesce(vol, F.lit(0.0))
    b = F.coalesce(F.when(beta != 0, beta), F.lit(1.0))
    return F.when((v > 0.40) | (b > 1.6), "Alto").when((v < 0.22) & (b < 0.85), "Baixo").otherwise("Moderado")


def opportunity_scan(df: DataFrame, **thresholds) -> DataFrame:
    """Qualified names with entry range, stop, targets, risk and horizon."""
    q = scan_criteria(df, **thresholds).filter("qualified")
    p = F.col("price")
    horizon = (F.when((F.col("signal") == "strong_buy") & (F.col("secondary_hits") == 3), "1-4")
               .when((F.col("total_score") >= 80) & (F.col("secondary_hits") >= 2), "2-6").otherwise("3-8"))
    return (q.withColumn("targets", scan_targets(p)).withColumn("stop_loss", F.round(p * 0.93, 2))
            .withColumn("entry_low", F.round(p * 0.98, 2)).withColumn("entry_high", F.round(p * 1.02, 2))
            .withColumn("risk", scan_risk(F.col("vol"), F.col("beta"))).withColumn("horizon", horizon))


def scan_counts(criteria: DataFrame) -> DataFrame:
    flags = ("p_score", "p_signal", "p_rsi", "p_macd", "s_cross", "s_volume", "s_bb", "qualified", "near_miss")
    return criteria.agg(F.count("*").alias("n_evaluated"), F.count_if(F.col("primary_hits") == 4).alias("n_primary"),
                        *[F.count_if(F.col(f)).alias(f) for f in flags])


def sector_medians(df: DataFrame) -> DataFrame:
    """Median positive earnings yield and price to book per sector, with at least two names each."""
    def med(col):
        pos = F.when(F.col(col) > 0, F.col(col))
        return F.when((F.count("*") >= 2) & (F.count(pos) >= 2), F.percentile(pos, 0.5))

    return df.groupBy("sector").agg(med("earnings_yield").alias("sector_ey"), med("pvp").alias("sector_pvp"))


def graham_constant(selic: Column) -> Column:
    """22.5 rescaled from a 4% risk-free rate; fallback rate when the input is implausible."""
    ok = selic.between(0.02, 0.50)
    return F.round(22.5 * (0.04 / F.when(ok, selic).otherwise(0.1375)), 4)


def trade_levels(df: DataFrame, selic: Column) -> DataFrame:
    """Targets, stop, reward to risk, type and horizon from price, fundamentals and indicators.

    Needs price, earnings_yield, pvp, sector, ma20/50/200, high_52w, atr, signal, macd_cross, rsi,
    dividend_yield, roe, alpha_6m, total_score.
    """
    c, p = F.col, F.col("price")
    df = df.filter(p > 0).join(sector_medians(df), "sector", "left")
    ey, pvp, ey_med, pvp_med = c("earnings_yield"), c("pvp"), c("sector_ey"), c("sector_pvp")
    pl_med = 1 / ey_med
    t_pl = F.when((ey != 0) & (ey_med > 0) & (pl_med <= 60), F.round(p * ey * pl_med, 2))
    book = p / F.when(pvp > 0, pvp)
    t_pvp = F.when((pvp_med > 0) & (book * pvp_med <= p * 3), F.round(book * pvp_med, 2))
    t_graham = F.when((ey > 0) & (pvp > 0), F.round(F.sqrt(graham_constant(selic) * p * ey * book), 2))
    df = df.withColumn("target_pl", t_pl).withColumn("target_pvp", t_pvp).withColumn("target_graham", t_graham)
    tech = F.transform(F.filter(F.array(*[c(x) for x in ("ma20", "ma50", "ma200", "high_52w")]),
                                lambda x: x.isNotNull() & (x > p)), lambda x: F.round(x, 2))
    levels = F.array_sort(F.filter(F.concat(F.array("target_pl", "target_pvp", "target_graham"), tech),
                                   lambda x: x.isNotNull() & (x > p * 1.025)))
    df = df.withColumn("_lv", levels)
    has = F.size("_lv") > 0
    df = (df.withColumn("target_conservative", F.when(has, F.element_at("_lv", 1)).otherwise(F.round(p * 1.10, 2)))
            .withColumn("_ext", F.when(has, F.element_at("_lv", -1)).otherwise(F.round(p * 1.20, 2))))
    df = df.withColumn("target_extended", F.when(c("_ext") <= c("target_conservative"),
                                                 F.round(c("target_conservative") * 1.10, 2)).otherwise(c("_ext")))
    cap = F.round(p * 0.90, 2)
    stop = (F.when((c("atr") > 0) & (c("atr") < p * 0.10), F.round(p - 2.0 * c("atr"), 2))
            .when((c("ma50") > p * 0.88) & (c("ma50") < p), F.round(c("ma50") * 0.99, 2))
            .otherwise(F.round(p * 0.93, 2)))
    df = df.withColumn("stop", F.least(F.greatest(stop, cap), F.round(p * 0.97, 2)))
    up = c("target_conservative") - p
    df = df.withColumn("rr", F.when(up > 0, F.round(up / F.greatest(p - c("stop"), F.lit(0.01)), 2)).otherwise(0.0))

    def yes(cond):
        return F.coalesce(cond, F.lit(False))

    value = yes(pvp < 1.3) | yes(c("dividend_yield") > 0.05)
    momentum = yes(c("alpha_6m") > 0.06) | yes((c("signal") == "strong_buy") & (c("macd_cross") == "bullish"))
    quality = yes(c("roe") > 0.18)
    hits = value.cast("int") + momentum.cast("int") + quality.cast("int")
    df = df.withColumn("opportunity_type", F.when(hits >= 2, "Misto").when(value, "Valor").when(momentum, "Momentum")
                       .when(quality, "Qualidade").otherwise("Misto"))
    rsi = F.coalesce(c("rsi"), F.lit(50.0))
    return (df.withColumn("horizon", F.when(yes((c("signal") == "strong_buy") & (c("macd_cross") == "bullish") & (rsi < 38)), "1-4")
                          .when(yes((c("total_score") >= 80) & c("signal").isin("buy", "strong_buy")), "2-6").otherwise("3-8"))
            .drop("_lv", "_ext"))


def level_alerts(levels: DataFrame, prices: DataFrame, on: list[str]) -> DataFrame:
    """Prices against stop and target levels; a hit stop silences the other alerts of the name."""
    df = levels.join(prices, on).filter("price > 0")
    p, stop, target = F.col("price"), F.when(F.col("stop") > 0, F.col("stop")), F.when(F.col("target") > 0, F.col("target"))
    dist = (p - stop) / p

    def alert(cond, kind, rank, level, distance):
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("severity"), level.alias("level"),
                                     F.round(distance, 4).alias("distance_pct")))

    hit = F.coalesce(p <= stop, F.lit(False))
    rows = F.array_compact(F.array(
        alert(hit, "stop_hit", 0, stop, dist), alert(~hit & (dist < STOP_NEAR), "stop_near", 1, stop, dist),
        alert(~hit & (p >= target), "target_hit", 2, target, (p - target) / p)))
    return df.withColumn("a", F.explode(rows)).select(*df.columns, "a.*")
