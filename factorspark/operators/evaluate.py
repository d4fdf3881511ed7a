"""Evaluation of stored recommendations: prices, dividends, attribution, walk-forward, NAV points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.operators import stats as S
from factorspark.operators import timeseries as ts

DEFAULT_NOISE_PP, MIN_NOISE_OBS = 1.2, 10


def price_at(holdings: DataFrame, bars: DataFrame, date: str, out: str, strict: bool = False) -> DataFrame:
    """Last close of each holding on or before its date."""
    px = bars.select("sid", "date", F.col("close").alias(out))
    return ts.asof(holdings, px, ["sid"], date, "date", [out], strict=strict).drop("date_matched")


def entry_prices(holdings: DataFrame, quotes: DataFrame, bars: DataFrame, date: str) -> DataFrame:
    """The quoted price where there is one, else the last close."""
    h = price_at(holdings, bars, date, "_last").join(quotes, ["sid"], "left")
    return h.withColumn("entry", F.coalesce("quote", "_last")).drop("_last", "quote")


def dividends_in_window(holdings: DataFrame, events: DataFrame, start: str, end: str) -> DataFrame:
    """Dividends per share with cum date in [start, end), and the part paid as interest on capital.

    The running total of a security's dividends at ``end`` less the one at ``start``: two as-of
    lookups, no pairing of holdings with events. ``events``: sid, date, value, label.
    """
    w = Window.partitionBy("sid").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    jcp = F.col("label").rlike("JRS|JCP")
    daily = events.groupBy("sid", "date").agg(F.sum("value").alias("v"), F.sum(F.when(jcp, F.col("value")).otherwise(0.0)).alias("j"))
    level = daily.select("sid", "date", F.sum("v").over(w).alias("_v"), F.sum("j").over(w).alias("_j"))
    a = ts.asof(holdings, level, ["sid"], start, "date", ["_v", "_j"], strict=True).drop("date_matched").withColumnsRenamed({"_v": "_v0", "_j": "_j0"})
    b = ts.asof(a, level, ["sid"], end, "date", ["_v", "_j"], strict=True).drop("date_matched")

    def diff(x, y):
        return F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))

    return b.withColumn("dividends", diff("_v", "_v0")).withColumn("jcp", diff("_j", "_j0")).drop("_v", "_j", "_v0", "_j0")


def attribution(holdings: DataFrame, keys: list[str]) -> DataFrame:
    """Weight, contribution and return per name, sector and in total, one grouping level per row.

    ``holdings``: keys, sector, sid, w, ret. ``level`` is name, sector or total. Holdings are exchanged once, by the keys, which
    serves all levels; sectors are summed from names and totals from sectors, so no row is repeated for its levels.
    """
    c = F.col("w") * F.coalesce("ret", F.lit(0.0))
    sums = [F.sum(x).alias(x) for x in ("weight", "contribution", "n")]
    names = holdings.select(*keys, "sector", "sid", "w", c.alias("_c")).repartition(*keys).groupBy(*keys, "sector", "sid").agg(
        F.sum("w").alias("weight"), F.sum("_c").alias("contribution"), F.count("*").alias("n"))
    sectors = names.groupBy(*keys, "sector").agg(*sums)
    totals = sectors.groupBy(*keys).agg(*sums)
    g = names.withColumn("level", F.lit("name"))
    for rows, level in ((sectors, "sector"), (totals, "total")):
        g = g.unionByName(rows.withColumn("level", F.lit(level)), allowMissingColumns=True)
    return g.withColumn("ret", F.when(F.col("weight") > 0, F.col("contribution") / F.col("weight")).otherwise(0.0))


def track_record(backtests: DataFrame, keys: list[str]) -> DataFrame:
    """Compounded results and win rate of the successful periods of each record series."""
    ok = backtests.filter("status = 'success' and period_days > 0")
    a = F.col("ret") - F.col("index_ret")
    return ok.withColumn("alpha", a).groupBy(*keys).agg(
        F.count("*").alias("n_periods"), (F.product(1 + F.col("ret")) - 1).alias("cum_portfolio"), (F.product(1 + F.col("index_ret")) - 1).alias("cum_index"),
        F.avg((F.col("alpha") > 0).cast("double")).alias("win_rate"), F.avg("alpha").alias("avg_alpha"))


def walk_forward(entries: DataFrame, holdings: DataFrame, bars: DataFrame, sessions: DataFrame, index: DataFrame, cdi: DataFrame,
                 horizons=(5, 20, 60)) -> DataFrame:
    """Portfolio, index and rate over the same window, per recommendation and horizon.

    ``entries``: rec, entry_sno; ``holdings``: rec, sid, w; ``bars``: sid, sno, close. A name without a
    price at the entry session earns nothing; a later gap keeps its last price. Windows that run
    past the last session are left out. Index and rate are levels by session, read at both ends.
    Holdings are sorted in among their security's bars once, for the prices at the entry and at all
    exits; the sums of all horizons stay side by side until a recommendation is one row.
    """
    last = sessions.agg(F.max("sno").alias("_last"))
    win = entries.filter("entry_sno is not null").join(F.broadcast(last)).filter(F.col("entry_sno") + min(horizons) <= F.col("_last"))
    rows = win.join(holdings, "rec").select("rec", "sid", "w", F.col("entry_sno").alias("sno"), F.lit(True).alias("_held"))
    both = rows.unionByName(bars.select("sid", "sno", "close", F.col("sno").alias("_at")), allowMissingColumns=True)
    by_sno = Window.partitionBy("sid").orderBy("sno")

    def price(back: int) -> Column:
        # frames that only grow: the last bar at or before the session
        return F.last(F.when(F.col("_at").isNotNull(), F.struct("_at", "close")), ignorenulls=True).over(by_sno.rangeBetween(Window.unboundedPreceding, back))

    both = both.select("rec", "sid", "w", "sno", "_held", price(0).alias("_p0"), *[price(h).alias(f"_p{h}x") for h in horizons]).filter("_held")
    p0 = F.when(F.col("sid").isNotNull() & (F.col("_p0._at") == F.col("sno")), F.col("_p0.close"))
    rets = [F.when(p0 > 0, F.col(f"_p{h}x.close") / p0 - 1).alias(f"_r{h}") for h in horizons]
    g = both.select("rec", F.col("sno").alias("entry_sno"), "w", *rets).groupBy("rec", "entry_sno").agg(
        F.count("*").alias("_n"), *[F.sum(F.col("w") * F.coalesce(f"_r{h}", F.lit(0.0))).alias(f"_s{h}") for h in horizons],
        *[F.count(f"_r{h}").alias(f"_c{h}") for h in horizons])
    hs = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"_s{h}").alias("port"), (F.col("_n") - F.col(f"_c{h}")).alias("n_missing")) for h in horizons]))
    g = (g.select("rec", "entry_sno", hs.alias("_h")).select("rec", "_h.h", "entry_sno", (F.col("entry_sno") + F.col("_h.h")).alias("exit_sno"), "_h.port", "_h.n_missing")
         .join(F.broadcast(last)).filter(F.col("exit_sno") <= F.col("_last")).drop("_last"))
    w = Window.partitionBy("_k").orderBy("sno")
    levels = (index.select("sno", "close").join(cdi.select("sno", "cdi"), "sno", "left").withColumn("_k", F.lit(1))
              .withColumn("_c", F.product(1 + F.coalesce("cdi", F.lit(0.0))).over(w)).drop("_k", "cdi"))
    for end, tag in (("entry_sno", "0"), ("exit_sno", "1")):
        # a row for each session, so runs stay where they are
        g = g.join(F.broadcast(levels.select(F.col("sno").alias(end), F.col("close").alias("_i" + tag), F.col("_c").alias("_c" + tag))), end)
    return (g.withColumn("index_ret", F.col("_i1") / F.col("_i0") - 1).withColumn("cdi_ret", F.col("_c1") / F.col("_c0") - 1)
            .withColumn("alpha", F.col("port") - F.col("index_ret")).withColumn("excess", F.col("port") - F.col("cdi_ret"))
            .drop("_i0", "_i1", "_c0", "_c1"))


def walk_forward_summary(periods: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Means, hit rate, Newey-West t, and non-overlapping Sharpe, drawdown and return per horizon.

    ``periods``: keys, h, order, port, alpha, excess. A key is one record series.
    """
    k = [*keys, "h"]
    w = Window.partitionBy(*k).orderBy(order)
    step = F.greatest(F.lit(1), F.ceil(F.col("h") / 5)).cast("int")
    rows = periods.withColumn("_step", step).withColumn("_i", F.row_number().over(w) - 1).withColumn("_own", F.col("_i") % F.col("_step") == 0)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    nav = F.product(F.when(F.col("_own"), 1 + F.col("port")).otherwise(1.0)).over(run)
    rows = rows.withColumn("_nav", nav)
    # the drawdown counts from the first compounded value
    rows = rows.withColumn("_dd", F.col("_nav") / F.max("_nav").over(run) - 1)
    ex = F.when(F.col("_own"), F.col("excess"))
    g = rows.groupBy(*k).agg(
        F.count("*").alias("n"), F.max("_step").alias("step"), F.avg("port").alias("mean_return"), F.percentile("port", 0.5).alias("median_return"),
        F.avg("alpha").alias("mean_alpha"), F.avg((F.col("alpha") > 0).cast("double")).alias("hit_rate"), F.avg(ex).alias("_m"),
        F.stddev_samp(ex).alias("_s"), F.count(ex).alias("n_own"), F.min("_dd").alias("max_drawdown"), (F.max_by("_nav", order) - 1).alias("cum_return"))
    nw = S.newey_west(rows.withColumn("_lag", F.col("_step") - 1), k, "alpha", order, F.col("_lag")).select(*k, "t_nw")
    sharpe = F.when((F.col("n_own") >= 3) & (F.col("_s") > 0), F.col("_m") / F.col("_s") * F.sqrt(252 / F.col("h")))
    return g.join(nw, k, "left").withColumn("n_eff", F.col("n") / F.col("step")).withColumn("sharpe", sharpe).drop("_m", "_s", "step")


def weighted_return(rows: DataFrame, keys: list[str], sleeves: DataFrame | None = None) -> DataFrame:
    """Sleeve return with kept weights: a name without a return counts as flat; null if none has one.

    With ``sleeves`` (keys, _w, _all: weight and number of all names with a weight above 0), ``rows`` need only hold names with a return.
    """
    g = rows.filter("w > 0").groupBy(*keys).agg(F.sum("w").alias("_w"), F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("_r"),
                                               F.count("ret").alias("_n"), (F.count("*") - F.count("ret")).alias("n_missing"))
    if sleeves is not None:
        g = sleeves.join(g.select(*keys, "_r", "_n"), keys, "left").withColumn("n_missing", F.col("_all") - F.coalesce("_n", F.lit(0)))
    return g.select(*keys, F.when(F.col("_n") > 0, F.col("_r") / F.col("_w")).alias("port_ret"), "n_missing")


def nav_summary(points: DataFrame, keys: list[str], order: str = "date") -> DataFrame:
    """Cumulative results in percentage points, daily alpha noise, and the verdict on the last day."""
    w = Window.partitionBy(*keys).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    lv = points
    for c in ("port_ret", "index_ret", "cdi_ret"):
        rate = F.last(c, ignorenulls=True).over(run) if c == "cdi_ret" else F.col(c)
        lv = lv.withColumn("_" + c, F.product(1 + F.coalesce(rate, F.lit(0.0))).over(run) - 1)
    a = F.when(F.col("port_ret").isNotNull() & F.col("index_ret").isNotNull(), (F.col("port_ret") - F.col("index_ret")) * 100)
    g = lv.withColumn("_a", a).groupBy(*keys).agg(
        F.count("*").alias("n_obs"), *[F.max_by("_" + c, order).alias("cum_" + c) for c in ("port_ret", "index_ret", "cdi_ret")],
        F.when(F.count("_a") >= MIN_NOISE_OBS, F.stddev_samp("_a")).otherwise(DEFAULT_NOISE_PP).alias("noise_pp"), F.max_by("_a", F.when(F.col("_a").isNotNull(), F.col(order))).alias("last_alpha_pp"))
    z = F.abs(F.col("last_alpha_pp")) / F.col("noise_pp")
    return (g.withColumn("alpha_index_pp", (F.col("cum_port_ret") - F.col("cum_index_ret")) * 100)
            .withColumn("alpha_cdi_pp", (F.col("cum_port_ret") - F.col("cum_cdi_ret")) * 100)
            .withColumn("verdict", F.when(z < 1, "noise").when(z < 2, "notable").when(z >= 2, "strong")))


def tail_risk(daily: DataFrame, keys: list[str], ret: str = "ret") -> DataFrame:
    """5% value at risk, expected shortfall, yearly volatility and plain Sharpe of daily returns."""
    q = daily.groupBy(*keys).agg(F.percentile(ret, 0.05).alias("var_95"))
    r = F.col(ret)
    g = daily.join(q, keys).groupBy(*keys).agg(
        F.count(ret).alias("n_obs"), F.max("var_95").alias("var_95"), F.avg(F.when(r <= F.col("var_95"), r)).alias("cvar_95"),
        (F.stddev_samp(r) * math.sqrt(252)).alias("ann_vol"), (F.avg(r) * 252).alias("_m"))
    return g.withColumn("sharpe_naive", F.col("_m") / F.when(F.col("ann_vol") > 0, F.col("ann_vol"))).drop("_m")


def concentration(weights: DataFrame, keys: list[str]) -> DataFrame:
    g = weights.groupBy(*keys).agg(F.sum(F.col("w") * F.col("w")).alias("hhi"))
    return g.withColumn("effective_n", 1 / F.when(F.col("hhi") > 0, F.col("hhi")))


def cost_adjusted(gross: Column, cost: Column) -> Column:
    """Gross return after paying the trading cost up front."""
    return (1 + gross) * (1 - cost) - 1
