"""Portfolios: weights, drift, turnover and cost, sleeve NAV, allocation, orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.scalars import FRICTION_BPS
from factorspark.operators import timeseries as ts

# Fixed values of the allocation rules.
SLEEVES = ("equities_br", "cdi", "global_usd", "inflation")
STATIC_MIX = {"equities_br": 0.40, "cdi": 0.30, "global_usd": 0.15, "inflation": 0.15}
BASE_MIX = {"risk_on": {"equities_br": 0.60, "cdi": 0.15, "global_usd": 0.15, "inflation": 0.10},
            "mean_rev": STATIC_MIX, "bear": {"equities_br": 0.20, "cdi": 0.50, "global_usd": 0.15, "inflation": 0.15}}
TILT, ERP_LOW, ERP_HIGH, EQUITY_MIN, EQUITY_MAX = 0.10, 0.02, 0.08, 0.10, 0.70
MIN_VOL, MAX_WEIGHT, MIN_WEIGHT = 0.10, 0.30, 0.05
BOUND_STEPS = 50
SIDE_COST = 10 / 10_000
TAX_FREE_SALES = 20_000.0


def normalize_weights(df: DataFrame, keys: list[str], weight: str, mode: str = "any_missing") -> DataFrame:
    """Weights summing to one per key (column ``w``).

    ``any_missing``: equal weights as soon as one weight is missing or the sum is not positive.
    ``sum``: missing weights count as zero; equal weights only when the sum is not positive.
    """
    total = F.sum(weight)
    g = df.groupBy(*keys).agg(total.alias("_s"), F.count("*").alias("_n"), F.count(weight).alias("_k"))
    usable = F.col("_s") > 0
    if mode == "any_missing":
        usable = usable & (F.col("_k") == F.col("_n"))
    w = F.when(F.coalesce(usable, F.lit(False)), F.coalesce(F.col(weight), F.lit(0.0)) / F.col("_s")).otherwise(1 / F.col("_n"))
    return df.join(g, keys).withColumn("w", w).drop("_s", "_n", "_k")


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _cap_floor(ws: Column, cap: Column, floor: Column) -> Column:
    """Weights between two bounds that sum to one, by a fold over the rounds of redistribution.

    A round lifts every weight to the floor, pins those at the cap and spreads what is left over the others in
    proportion. The fold's state is the weights and whether they have settled; settled ones pass through.
    """
    n = F.size(ws)
    even = F.transform(ws, lambda _: 1.0 / n)
    plus = F.transform(ws, lambda x: F.greatest(x, F.lit(0.0)))

    def rescaled(xs):
        total = _total(xs)
        return F.transform(xs, lambda x: x / F.when(total > 0, total))

    def spread(lifted):
        free = F.filter(lifted, lambda x: x < cap)
        left = (1.0 - cap * (n - F.size(free))) / F.when(F.size(free) > 0, _total(free))
        return F.transform(lifted, lambda x: F.when(x < cap, x * left).otherwise(cap))

    def settled(lifted, moved):
        return F.forall(F.arrays_zip(lifted.alias("was"), moved.alias("now")), lambda z: (z["was"] >= cap) | z["now"].between(floor - 1e-9, cap + 1e-9))

    def one(state, _):
        lifted = F.transform(state["w"], lambda x: F.greatest(x, floor))
        moved = spread(lifted)
        none_free = ~F.exists(lifted, lambda x: x < cap)
        turn = F.when(none_free, F.struct(even.alias("w"), F.lit(True).alias("done"))).otherwise(F.struct(moved.alias("w"), settled(lifted, moved).alias("done")))
        return F.when(state["done"], state).otherwise(turn)

    start = F.struct(rescaled(plus).alias("w"), F.lit(False).alias("done"))
    bounded = rescaled(F.aggregate(F.sequence(F.lit(1), F.lit(BOUND_STEPS)), start, one)["w"])
    feasible = (n > 0) & (cap * n >= 1.0) & (floor * n <= 1.0) & (_total(plus) > 0)
    return F.transform(F.when(feasible, bounded).otherwise(even), lambda x: F.round(x, 6))


def bounded_live(ws: Column, cap: float = MAX_WEIGHT, floor: float = MIN_WEIGHT) -> Column:
    """Cap and floor by redistribution among the names not at the cap; equal when infeasible.

    ``ws``: the weights of one portfolio as an array (a handful of names).
    """
    return _cap_floor(ws, F.lit(cap), F.lit(floor))


def bounded_study(ws: Column, lo: float = MIN_WEIGHT, hi: float = MAX_WEIGHT, steps: int = 20) -> Column:
    """Repeated clipping and rescaling, at most ``steps`` times."""
    total0 = _total(ws)
    start = F.transform(ws, lambda x: x / total0)

    def step(s, _):
        cut = F.transform(s["w"], lambda x: F.greatest(F.lit(lo), F.least(F.lit(hi), x)))
        w = F.transform(cut, lambda x: x / _total(cut))
        done = (F.array_max(w) <= hi + 1e-9) & (F.array_min(w) >= lo - 1e-9)
        return F.when(s["done"], s).otherwise(F.struct(w.alias("w"), done.alias("done")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(start.alias("w"), F.lit(False).alias("done")), step)["w"]


def inverse_vol_weights(df: DataFrame, keys: list[str], vol: str, variant: str = "live", order: str = "sid") -> DataFrame:
    """Inverse-volatility weights of each key's (few) picks under position bounds.

    ``live``: missing volatility takes the mean inverse volatility; ``study``: it counts as 0.3.
    A key holds one portfolio, a handful of names by construction.
    """
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, F.col(vol).alias("v")))).alias("r"))
    # steps are columns of their own, as the analyzer resolves nested array functions level by level
    if variant == "live":
        g = g.withColumn("inv", F.transform("r", lambda x: F.when(x["v"] > 0, 1 / F.greatest(x["v"], F.lit(MIN_VOL)))))
        g = g.withColumn("known", F.filter("inv", lambda x: x.isNotNull()))
        g = g.withColumn("mean", _total(F.col("known")) / F.size("known"))
        g = g.withColumn("raw", F.transform("inv", lambda x: F.coalesce(x, F.col("mean"))))
        ws = F.when(F.size("known") > 0, bounded_live(F.col("raw"))).otherwise(F.transform("r", lambda _: F.round(1 / F.size("r"), 6)))
    else:
        ws = bounded_study(F.transform("r", lambda x: 1 / F.greatest(F.coalesce(x["v"], F.lit(0.3)), F.lit(MIN_VOL))))
    g = g.withColumn("ws", ws)
    z = F.arrays_zip(F.transform("r", lambda x: x[order]).alias("id"), F.col("ws").alias("w"))
    return (g.select(*keys, F.explode(z).alias("z")).select(*keys, F.col("z.id").alias(order), F.col("z.w").alias("w")))


def transaction_cost(new: DataFrame, old: DataFrame, keys: list[str], costs: DataFrame | None = None) -> DataFrame:
    """Cost and one-way turnover of moving from ``old`` to ``new`` weights (keys, sid, w).

    ``costs`` (keys, sid, friction) may lack names; those pay the base rate.
    """
    j = (new.select(*keys, "sid", F.col("w").alias("_n")).join(old.select(*keys, "sid", F.col("w").alias("_o")), [*keys, "sid"], "full_outer"))
    if costs is not None:
        j = j.join(costs, [*keys, "sid"], "left")
        fr = F.coalesce("friction", F.lit(FRICTION_BPS / 10_000))
    else:
        fr = F.lit(FRICTION_BPS / 10_000)
    dw = F.abs(F.coalesce("_n", F.lit(0.0)) - F.coalesce("_o", F.lit(0.0)))
    return j.withColumn("_d", dw).groupBy(*keys).agg(F.sum(F.col("_d") * fr).alias("cost"), (F.sum("_d") / 2).alias("turnover"))


def drifted(weights: DataFrame, keys: list[str], ret: str) -> DataFrame:
    """Weights after the period's returns; unchanged where the portfolio is wiped out."""
    grown = F.col("w") * (1 + F.coalesce(F.col(ret), F.lit(0.0)))
    total = weights.withColumn("_g", grown).groupBy(*keys).agg(F.sum("_g").alias("_t"))
    return weights.withColumn("_g", grown).join(total, keys).withColumn(
        "w", F.when(F.col("_t") > 0, F.col("_g") / F.col("_t")).otherwise(F.col("w"))).drop("_g", "_t")


def rebalanced_returns(weights: DataFrame, costs: DataFrame, variant: list[str]) -> DataFrame:
    """Gross and net return and turnover of each rebalance of each variant.

    ``weights``: variant columns, t, sid, w, fwd. ``costs``: t, sid, friction. The portfolio before
    a rebalance is the previous one after its drift, found by renaming each period to its successor
    (a small table of dates), so the whole history is one join and not a loop over dates.
    """
    dates = weights.select(*variant, "t").distinct()
    nxt = dates.withColumn("t_next", F.lead("t").over(Window.partitionBy(*variant).orderBy("t")))
    before = (drifted(weights, [*variant, "t"], "fwd").join(nxt, [*variant, "t"]).filter("t_next is not null")
              .select(*variant, F.col("t_next").alias("t"), "sid", "w"))
    gross = weights.groupBy(*variant, "t").agg(F.sum(F.col("w") * F.coalesce("fwd", F.lit(0.0))).alias("gross"), F.count("*").alias("n"))
    keys = [*variant, "t"]
    old = before.select(*keys, "sid", F.col("w").alias("_o"))
    j = weights.select(*keys, "sid", F.col("w").alias("_n")).join(old, [*keys, "sid"], "full_outer").join(costs, ["t", "sid"], "left")
    dw = F.abs(F.coalesce("_n", F.lit(0.0)) - F.coalesce("_o", F.lit(0.0)))
    fr = F.coalesce("friction", F.lit(FRICTION_BPS / 10_000))
    moved = j.withColumn("_d", dw).groupBy(*keys).agg(F.sum(F.col("_d") * fr).alias("cost"), (F.sum("_d") / 2).alias("turnover"))
    return gross.join(moved, keys).withColumn("net", F.col("gross") - F.col("cost"))


def drift_nav(returns: DataFrame, targets: DataFrame, variant: list[str], k: int = 21, base: float = 100.0) -> DataFrame:
    """NAV of sleeves rebalanced every ``k`` sessions that drift in between.

    ``returns``: variant, i (0-based session), date, sleeve, ret (null counts as 0); ``targets``:
    variant, i (multiples of k), sleeve, w. Weights set at the close of i earn from i + 1 on. Within
    a period a sleeve grows by its running product; the turnover at a rebalance compares the new
    target with the drifted end weights; the NAV is the product of period growths after costs. All
    windows run over sessions of one variant, bounded by the calendar.
    """
    period = F.floor((F.col("i") - 1) / k).cast("int")
    grow = F.product(1 + F.coalesce("ret", F.lit(0.0))).over(
        Window.partitionBy(*variant, "sleeve", "p").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    r = returns.filter("i >= 1").withColumn("p", period).withColumn("_g", grow)
    tgt = targets.withColumn("p", F.floor(F.col("i") / k).cast("int")).select(*variant, "p", "sleeve", "w")
    held = r.join(tgt, [*variant, "p", "sleeve"]).withColumn("_v", F.col("w") * F.col("_g"))
    day = held.groupBy(*variant, "p", "i", "date").agg(F.sum("_v").alias("growth"))
    # end-of-period drifted weights against the next target
    last = held.groupBy(*variant, "p").agg(F.max("i").alias("i"))
    ends = held.join(last, [*variant, "p", "i"]).withColumn("_end", F.col("_v") / F.sum("_v").over(Window.partitionBy(*variant, "p")))
    before = ends.select(*variant, (F.col("p") + 1).alias("p"), "sleeve", F.col("_end").alias("_o"))
    j = tgt.join(before, [*variant, "p", "sleeve"], "full_outer")
    live_periods = tgt.select(*variant, "p").distinct()
    turn = (j.join(live_periods, [*variant, "p"], "left_semi")
            .withColumn("_d", F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("_o", F.lit(0.0))))
            .groupBy(*variant, "p").agg(F.sum("_d").alias("traded")))
    full = day.groupBy(*variant, "p").agg(F.max_by("growth", "i").alias("whole"))
    w = Window.partitionBy(*variant).orderBy("p")
    start = (turn.join(full, [*variant, "p"], "left").withColumn("keep", 1 - F.col("traded") * SIDE_COST)
             .withColumn("_past", F.coalesce(F.product(F.col("keep") * F.coalesce("whole", F.lit(1.0))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)))
             .withColumn("start", F.lit(base) * F.col("_past") * F.col("keep")))
    nav = day.join(start.select(*variant, "p", "start", "traded"), [*variant, "p"]).select(
        *variant, "i", "date", (F.col("start") * F.col("growth")).alias("nav"))
    first = returns.filter("i = 0").select(*variant, "i", "date", F.lit(base).alias("nav")).distinct()
    return first.unionByName(nav)


def mix_to_rows(df: DataFrame, mix: dict[str, Column]) -> DataFrame:
    """One row per sleeve with its weight."""
    e = F.explode(F.array(*[F.struct(F.lit(s).alias("sleeve"), w.cast("double").alias("w")) for s, w in mix.items()]))
    return df.withColumn("_e", e).select(*df.columns, "_e.*")


def regime_base(regime: Column) -> dict[str, Column]:
    """Base weight of every sleeve for a regime column; unknown regimes are neutral."""
    out = {}
    for s in SLEEVES:
        expr = F.when(regime == "risk_on", F.lit(BASE_MIX["risk_on"][s])).when(regime == "bear", F.lit(BASE_MIX["bear"][s]))
        out[s] = expr.otherwise(F.lit(STATIC_MIX[s]))
    return out


def dynamic_mix(regime: Column, erp: Column | None, tsmom: Column, gross: Column | None = None) -> dict[str, Column]:
    """Regime base with the equity tilts, bounded; tilts and freed capital move to cash."""
    base = regime_base(regime)
    tilt = F.when(tsmom > 0, TILT).when(tsmom <= 0, -TILT).otherwise(0.0)
    if erp is not None:
        tilt = tilt + F.when(erp < ERP_LOW, -TILT).when(erp > ERP_HIGH, TILT).otherwise(0.0)
    eq = F.greatest(F.lit(EQUITY_MIN), F.least(F.lit(EQUITY_MAX), base["equities_br"] + tilt))
    cash = F.greatest(base["cdi"] - (eq - base["equities_br"]), F.lit(0.0))
    if gross is not None:
        g = F.greatest(F.lit(0.0), F.least(F.lit(1.0), gross))
        cash, eq = cash + eq * (1 - g), eq * g
    total = eq + cash + base["global_usd"] + base["inflation"]
    return {"equities_br": eq / total, "cdi": cash / total, "global_usd": base["global_usd"] / total, "inflation": base["inflation"] / total}


def implied_premium(basket: DataFrame, rates: DataFrame, sessions: int = 252) -> DataFrame:
    """Earnings yield of the basket in force at each date less the yearly rate: (date, erp).

    ``basket``: t, sid, ey, the names picked at t; those without a yield don't count, and a basket without any gives null, which tilts nothing.
    ``rates``: date, cdi, a daily rate. Both are small: a row per date after one aggregate.
    """
    y = basket.groupBy("t").agg(F.avg("ey").alias("ey")).withColumn("_k", F.lit(1))
    hit = ts.asof(rates.select("date", "cdi").withColumn("_k", F.lit(1)), y, ["_k"], "date", "t", ["ey"])
    return hit.select("date", (F.col("ey") - (F.pow(1 + F.col("cdi"), F.lit(float(sessions))) - 1)).alias("erp"))


def tsmom_excess(index: DataFrame, cdi: DataFrame, window: int = 252, skip: int = 21) -> DataFrame:
    """12-1 return of the index minus the rate compounded over as many sessions.

    ``index``: date, sno, close; ``cdi``: date, cdi. Single series on the market calendar. A shorter
    history is clipped to the second session, as in the live rule.
    """
    w = Window.partitionBy("_k").orderBy("sno")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    df = (index.join(cdi, "date", "left").withColumn("_k", F.lit(1))
          .withColumn("_lvl", F.sum(F.log1p(F.coalesce("cdi", F.lit(0.0)))).over(run))
          .withColumn("_n", F.row_number().over(w)).withColumn("_p2", F.nth_value("close", 2).over(run)))
    n = F.col("_n")
    past = F.when(n > window, F.lag("close", window - 1).over(w)).otherwise(F.col("_p2"))
    ret = F.lag("close", skip).over(w) / past - 1
    # the rate over the last (span - skip) sessions
    full = F.col("_lvl") - F.lag("_lvl", window - skip).over(w)
    df = df.withColumn("_ret", ret).withColumn("_full", full)
    # for a short history the window holds n - 1 - skip sessions: level at n minus level at skip + 1
    base = F.nth_value("_lvl", skip + 1).over(run)
    cash = F.exp(F.when(n > window, F.col("_full")).otherwise(F.col("_lvl") - base)) - 1
    return df.select("date", "sno", F.when(n >= skip + 30, F.col("_ret") - cash).alias("tsmom"))


def order_sheet(accounts: DataFrame, sleeves: DataFrame, picks: DataFrame, prices: DataFrame) -> DataFrame:
    """Whole-share orders of many accounts at once.

    ``accounts``: account, rec, capital; ``sleeves``: rec, equity_w, cdi_w; ``picks``: rec, sid, w;
    ``prices``: rec, sid, price. One row per account and name, with the account's residual cash.
    """
    df = accounts.join(sleeves, "rec").withColumn("equity", F.round(F.col("capital") * F.col("equity_w"), 2)).join(picks, "rec")
    df = df.join(prices, ["rec", "sid"], "left").withColumn("target", F.col("equity") * F.col("w"))
    ok = F.col("price") > 0
    df = df.withColumn("qty", F.when(ok, F.floor(F.col("target") / F.col("price"))))
    done = F.coalesce(F.col("qty") * F.col("price"), F.lit(0.0))
    return df.withColumn("value", F.when(ok, F.round(done, 2))).withColumn("unused", F.col("target") - done)


def order_summary(orders: DataFrame, previous: DataFrame) -> DataFrame:
    """Per account: residual, cash sleeve, exits, entries, estimated sales and tax bracket.

    ``previous``: rec, sid of the portfolio held before.
    """
    held = previous.groupBy("rec").agg(F.count("*").alias("n_prev"))
    now = orders.select("account", "rec", "sid")
    kept = now.join(previous, ["rec", "sid"], "left_semi").groupBy("account", "rec").agg(F.count("*").alias("n_kept"))
    g = orders.groupBy("account", "rec").agg(F.max("capital").alias("capital"), F.max("equity").alias("equity"), F.max("cdi_w").alias("cdi_w"),
                                             F.sum("unused").alias("residual"), F.count("*").alias("n_now"))
    j = g.join(held, "rec", "left").join(kept, ["account", "rec"], "left").fillna(0, ["n_prev", "n_kept"])
    exits = F.col("n_prev") - F.col("n_kept")
    sales = F.when(F.col("n_prev") > 0, F.col("equity") / F.col("n_prev") * exits).otherwise(0.0)
    return (j.withColumn("exits", exits).withColumn("entries", F.when(F.col("n_prev") > 0, F.col("n_now") - F.col("n_kept")).otherwise(0))
            .withColumn("cdi_value", F.round(F.round(F.col("capital") * F.col("cdi_w"), 2) + F.col("residual"), 2))
            .withColumn("sales", sales)
            .withColumn("tax", F.when(F.col("sales") <= 0, "none").when(F.col("sales") < TAX_FREE_SALES, "exempt").otherwise("taxed")))


def backtest(holdings: DataFrame, keys: list[str]) -> DataFrame:
    """Return per recommendation: a name without a price keeps its weight and earns nothing.

    ``holdings``: keys, sid, w, entry, price, dividends. Status success / partial / no_history.
    """
    ok = (F.col("entry") > 0) & F.col("price").isNotNull()
    ret = (F.col("price") + F.coalesce("dividends", F.lit(0.0))) / F.col("entry") - 1
    g = holdings.withColumn("ret", F.when(ok, ret)).groupBy(*keys).agg(
        F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("gross"), F.count("ret").alias("priced"), F.count("*").alias("n"))
    status = F.when(F.col("priced") == F.col("n"), "success").when(F.col("priced") > 0, "partial_data").otherwise("no_history")
    return g.withColumn("status", status).withColumn("gross", F.when(F.col("priced") > 0, F.col("gross")))
