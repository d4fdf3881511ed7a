"""Price history: share types, renames, stable ids, split and dividend adjustment, universe."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.operators import timeseries as ts
from factorspark.session import cut_lineage

# Tradable equity types, split ratios to test, thresholds.
EQUITY_TYPES = ("ON", "PN", "PNA", "PNB", "PNC", "PND", "PNE", "PNF", "UNT")
COMMON_RATIOS = (2, 3, 4, 5, 8, 10, 20, 25, 50, 100, 1000,
                 1 / 2, 1 / 3, 1 / 4, 1 / 5, 1 / 8, 1 / 10, 1 / 20, 1 / 25, 1 / 50, 1 / 100, 1 / 1000,
                 1.25, 1.5, 0.8)
BONUS_RATIOS = (1.05, 1.1, 1.15, 1.2, 1.3, 1.4, 1.6, 1 / 1.05, 1 / 1.1, 1 / 1.2)
EVENT_TOLERANCE = 0.25
JUMP_TOLERANCE = 0.10
JUMP_LOW, JUMP_HIGH = 0.6, 1.6
NEAR_ROWS = 3
BIG_MOVE, PATCH_GAP = 0.25, 0.15
REBALANCE_PERIOD_MONTHS = 4


def share_type(spec: Column) -> Column:
    """First word of the specification without trailing stars."""
    return F.regexp_replace(F.split(F.trim(spec), r"\s+")[0], r"\*+$", "")


def equities_only(df: DataFrame) -> DataFrame:
    return df.filter(share_type(F.col("spec")).isin(*EQUITY_TYPES))


def ex_marker(spec: Column) -> Column:
    """The first ex-token (E plus one to three letters) after the share type, else ''."""
    rest = F.regexp_replace(F.trim(spec), r"^\S+\s*", "")
    return F.regexp_extract(rest, r"(?:^|\s)(E[A-Z]{1,3})(?=\s|$)", 1)


def next_session(events: DataFrame, bars: DataFrame, key: str = "sid") -> DataFrame:
    """Ex-date: the security's first session strictly after the last cum date."""
    return ts.asof(events, bars.select(key, "date"), [key], "last_date_prior", "date", [],
                   strict=True, forward=True).withColumnRenamed("date_matched", "ex_date")


def map_cash_events(cash: DataFrame, listings: DataFrame) -> DataFrame:
    """Cash events by issuer root and share type to securities."""
    pairs = listings.select("root", "type", "sid").distinct()
    return cash.join(pairs, ["root", "type"]).dropDuplicates(["sid", "last_date_prior", "value", "label"])


def nearest_ratio(observed: Column, ratios) -> Column:
    """The split ratio that brings the observed price ratio closest to one, with its distance."""
    return F.array_min(F.array(*[
        F.struct(F.abs(F.log(observed * F.lit(float(k)))).alias("gap"), F.lit(float(k)).alias("ratio"))
        for k in sorted(set(map(float, ratios)))]))


def _near(mult: str, w: Window) -> Column:
    return F.max(F.when(F.col(mult) != 1.0, 1).otherwise(0)).over(w.rowsBetween(-NEAR_ROWS, NEAR_ROWS)) == 1


def split_passes(bars: DataFrame, cash: DataFrame, stock: DataFrame) -> DataFrame:
    """Dividends and the accepted split multiplier of every session.

    Three ordered passes, each seeing the events the one before accepted: exchange events the
    price confirms, new ex-markers, unexplained jumps. All windows share one sort by security.
    ``source``/``accepted``/``candidate`` describe the decision of the session, if there was one.
    """
    div = (next_session(cash, bars).filter("ex_date is not null")
           .groupBy("sid", F.col("ex_date").alias("date")).agg(F.sum("value").alias("dividend")))
    net = (next_session(stock, bars).filter("ex_date is not null")
           .groupBy("sid", F.col("ex_date").alias("date")).agg(F.product("multiplier").alias("event_mult")))
    w = ts.by_row()
    df = (bars.join(div, ["sid", "date"], "left").join(net, ["sid", "date"], "left")
          .withColumn("dividend", F.coalesce("dividend", F.lit(0.0)))
          .withColumn("prev", F.lag("close").over(w))
          .withColumn("raw", (F.col("close") + F.col("dividend")) / F.col("prev"))
          .withColumn("marker", ex_marker(F.col("spec")))
          .withColumn("prev_marker", F.lag("marker").over(w)))
    raw = F.col("raw")

    tested = raw.isNotNull() & F.col("event_mult").isNotNull() & (F.abs(F.col("event_mult") - 1) >= 1e-9)
    confirmed = F.abs(F.log(raw * F.col("event_mult"))) <= EVENT_TOLERANCE
    df = (df.withColumn("rejected", tested & ~confirmed)
            .withColumn("m1", F.when(tested & confirmed, F.col("event_mult")).otherwise(1.0)))

    fresh = (F.col("prev_marker").isNull() | (F.col("marker") != F.col("prev_marker"))) & F.substring("marker", 2, 3).rlike("[BGX]")
    df = (df.withColumn("try2", fresh & ~_near("m1", w) & raw.isNotNull())
            .withColumn("n2", F.when(F.col("try2"), nearest_ratio(raw, COMMON_RATIOS + BONUS_RATIOS))))
    ok2 = (F.col("n2.gap") < F.abs(F.log(raw)) - 0.02) & (F.col("n2.gap") <= 0.05)
    df = df.withColumn("ok2", F.col("try2") & F.coalesce(ok2, F.lit(False))).withColumn(
        "m2", F.col("m1") * F.when(F.col("ok2"), F.col("n2.ratio")).otherwise(1.0))

    df = (df.withColumn("try3", ((raw < JUMP_LOW) | (raw > JUMP_HIGH)) & ~_near("m2", w) & raw.isNotNull())
            .withColumn("n3", F.when(F.col("try3"), nearest_ratio(raw, COMMON_RATIOS))))
    df = df.withColumn("ok3", F.col("try3") & F.coalesce(F.col("n3.gap") <= JUMP_TOLERANCE, F.lit(False))).withColumn(
        "split_mult", F.col("m2") * F.when(F.col("ok3"), F.col("n3.ratio")).otherwise(1.0))
    return df


def review_log(passes: DataFrame) -> DataFrame:
    """Rejected events, tested markers and tested jumps, one row per decision."""
    def entry(on, mult, source, accepted):
        return F.when(on, F.struct(mult.cast("double").alias("multiplier"), source.alias("source"),
                                   accepted.alias("accepted")))

    rows = F.array_compact(F.array(
        entry(F.col("rejected"), F.col("event_mult"), F.lit("b3_rejected"), F.lit(False)),
        entry(F.col("try2"), F.col("n2.ratio"), F.concat(F.lit("marker_"), F.col("marker")), F.col("ok2")),
        entry(F.col("try3"), F.col("n3.ratio"), F.lit("jump"), F.col("ok3"))))
    return (passes.withColumn("row", F.explode(rows))
            .select("sid", "ticker", "date", F.round("raw", 5).alias("raw_ratio"), "row.*"))


def total_return(passes: DataFrame) -> DataFrame:
    """Price and total return of each session from the accepted multiplier and dividend."""
    grown = F.col("close") * F.col("split_mult")
    return (passes.withColumn("ret_price", grown / F.col("prev") - 1)
            .withColumn("ret_total", (grown + F.col("dividend")) / F.col("prev") - 1))


def adjusted_close(df: DataFrame) -> DataFrame:
    """Compounded price and total-return levels that end at the last raw close.

    Both levels equal the last close divided by the growth still to come, so one backward
    running product per series gives them.
    """
    w = Window.partitionBy("sid").orderBy(F.col("date").desc())
    after = w.rowsBetween(Window.unboundedPreceding, -1)
    last = F.first("close").over(w.rowsBetween(Window.unboundedPreceding, 0))

    def level(ret):
        to_come = F.product(1 + F.coalesce(F.col(ret), F.lit(0.0))).over(after)
        return last / F.coalesce(to_come, F.lit(1.0))

    return df.withColumn("adj_close", level("ret_price")).withColumn("tr_close", level("ret_total"))


def adjusted_prices(bars: DataFrame, cash: DataFrame, stock: DataFrame) -> DataFrame:
    """Bars plus events to the adjusted series."""
    df = adjusted_close(total_return(split_passes(bars, cash, stock)))
    return df.select("sid", "ticker", "date", "close", "volume", "trades", "split_mult", "dividend",
                     "ret_price", "ret_total", "adj_close", "tr_close")


def patch_big_moves(series: DataFrame, reference: DataFrame) -> DataFrame:
    """Checks moves above 25% against a second source (ticker, date, ret) and re-chains.

    The reference wins where both differ by more than 15 points and it is the smaller move.
    ``action`` is null on ordinary days.
    """
    ref = reference.select("ticker", "date", F.col("ret").alias("ret_reference"))
    df = series.join(ref, ["ticker", "date"], "left")
    mine, other = F.col("ret_total"), F.col("ret_reference")
    big = F.abs(mine) > BIG_MOVE
    patch = (F.abs(mine - other) > PATCH_GAP) & (F.abs(other) < F.abs(mine))
    df = df.withColumn("action", F.when(big, F.when(other.isNull(), "no_reference")
                                        .when(patch, "patched").otherwise("confirmed")))
    hit = F.col("action") == "patched"
    df = (df.withColumn("ret_raw", mine)
            .withColumn("ret_price", F.when(hit, other).otherwise(F.col("ret_price")))
            .withColumn("ret_total", F.when(hit, other).otherwise(mine)))
    return adjusted_close(df)


def detect_renames(bars: DataFrame, sessions: DataFrame, min_avg_volume: float = 1e6,
                   max_gap: float = 0.20, max_volume_ratio: float = 10.0) -> DataFrame:
    """Ticker pairs where one stops and a like one starts in the next session.

    ``bars``: ticker, date, spec, open, close, volume. The equality on session and type keeps
    candidates to listings that start on one day; the bands filter the rest. Head and tail
    volumes come from ranked rows, so the whole step shuffles on ticker once. Listings are read by
    both sides and written out for that. Candidates are only counted, a number for each old ticker;
    the one candidate of those that have no second is then looked up, so no list of pairs is kept.
    """
    eq = equities_only(bars).withColumn("type", share_type(F.col("spec"))).join(sessions, "date")
    up = Window.partitionBy("ticker").orderBy("date")
    down = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    eq = eq.withColumn("_i", F.row_number().over(up)).withColumn("_j", F.row_number().over(down))
    life = eq.groupBy("ticker").agg(
        F.min("sno").alias("first_sno"), F.max("sno").alias("last_sno"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.min_by("open", "date").alias("open"), F.max_by("close", "date").alias("close"),
        F.min_by("type", "date").alias("first_type"), F.max_by("type", "date").alias("last_type"),
        F.avg(F.when(F.col("_i") <= 20, F.col("volume"))).alias("head_volume"),
        F.avg(F.when(F.col("_j") <= 20, F.col("volume"))).alias("tail_volume"))
    life = cut_lineage(life)
    old = life.filter(F.col("tail_volume") >= min_avg_volume).select(
        F.col("ticker").alias("old"), (F.col("last_sno") + 1).alias("sno"), F.col("last_type").alias("type"),
        "last_date", "close", "tail_volume")
    new = life.select(F.col("ticker").alias("new"), F.col("first_sno").alias("sno"),
                      F.col("first_type").alias("type"), "first_date", "open", "head_volume")
    gap = F.col("open") / F.col("close") - 1
    ratio = F.col("head_volume") / F.greatest(F.col("tail_volume"), F.lit(1.0))
    like = (F.abs(gap) <= max_gap) & ratio.between(1 / max_volume_ratio, max_volume_ratio)
    # an old ticker with several candidates is ambiguous; a new one keeps its closest predecessor
    once = old.join(new.drop("new", "first_date"), ["sno", "type"]).filter(like).groupBy("old").agg(F.count("*").alias("n")).filter("n = 1")
    sure = (old.join(once.select("old"), "old").join(new, ["sno", "type"]).filter(like)
            .withColumn("price_gap", F.round(gap, 4)).withColumn("volume_ratio", F.round(ratio, 2)))
    best = sure.groupBy("new").agg(F.min(F.struct(F.abs(F.col("price_gap")).alias("g"), "old",
                                                  *[F.col(c).alias("_" + c) for c in sure.columns])).alias("b"))
    return best.select(F.col("b._old").alias("old"), F.col("b._new").alias("new"),
                       F.col("b._last_date").alias("last_date"), F.col("b._first_date").alias("first_date"),
                       F.col("b._price_gap").alias("price_gap"), F.col("b._volume_ratio").alias("volume_ratio"))


def chain_roots(tickers: DataFrame, edges: DataFrame) -> DataFrame:
    """Stable id: the first ticker of the rename chain of each ticker.

    Pointer jumping: every round doubles the distance a ticker looks back, so a chain of length L
    needs log2(L) joins instead of L. Each round is written to the shared folder, because the next
    one reads it twice. Members of a cycle keep their own name.
    """
    hop = edges.select(F.col("new").alias("ticker"), F.col("old").alias("root"))
    hop = cut_lineage(hop)
    rounds = max(1, math.ceil(math.log2(hop.count() + 1)) + 1)
    open_ends = 1
    for _ in range(rounds):
        up = hop.select(F.col("ticker").alias("root"), F.col("root").alias("_next"))
        joined = cut_lineage(hop.join(up, "root", "left"))
        open_ends = joined.filter("_next is not null").limit(1).count()
        hop = joined.select("ticker", F.coalesce("_next", "root").alias("root"))
        if not open_ends:
            break
    if open_ends:
        heads = hop.select(F.col("ticker").alias("root")).distinct()
        hop = (hop.join(heads.withColumn("_inside", F.lit(True)), "root", "left")
               .select("ticker", F.when(F.col("_inside"), F.col("ticker")).otherwise(F.col("root")).alias("root")))
    return (tickers.select("ticker").distinct().join(hop, "ticker", "left")
            .select("ticker", F.coalesce("root", "ticker").alias("sid")))


def rebalance_dates(sessions: DataFrame) -> DataFrame:
    """First session of each January, May and September, with a running period number."""
    period = F.year("date") * 3 + F.floor((F.month("date") - 1) / REBALANCE_PERIOD_MONTHS)
    return (sessions.filter((F.month("date") % REBALANCE_PERIOD_MONTHS) == 1)
            .groupBy(period.cast("int").alias("period"))
            .agg(F.min("date").alias("rebalance_date")))


def liquidity_stats(bars: DataFrame, sessions: DataFrame, lookback_days: int = 365) -> DataFrame:
    """Per rebalance date and security, totals over the window strictly before the date.

    A bar belongs to at most the next four rebalances, so it is expanded to those period numbers
    and joined by equality. The dates of the rebalances, three a year, are broadcast: expanded bars
    are never exchanged, neither by period nor by date.
    """
    reb = rebalance_dates(sessions)
    period = (F.year("date") * 3 + F.floor((F.month("date") - 1) / REBALANCE_PERIOD_MONTHS)).cast("int")

    def windows(rows: DataFrame) -> DataFrame:
        return (rows.withColumn("period", F.explode(F.sequence(period + 1, period + 4))).join(F.broadcast(reb), "period")
                .filter((F.col("date") < F.col("rebalance_date"))
                        & (F.col("date") >= F.date_sub("rebalance_date", lookback_days))))

    rows = equities_only(bars)
    # a bar is exchanged once, before it is expanded; a security has at most a bar a day
    stats = windows(rows.repartition("sid")).groupBy("rebalance_date", "sid").agg(
        F.max_by("ticker", "date").alias("ticker"), F.max_by("isin", "date").alias("isin"),
        F.sum("trades").alias("trades"), F.round(F.sum("volume"), 2).alias("volume"),
        F.count("*").alias("sessions"), F.max_by("close", "date").alias("last_close"),
        F.max("date").alias("last_date"))
    total = windows(rows.select("date").distinct()).groupBy("rebalance_date").agg(
        F.count("*").alias("n_sessions"), F.max("date").alias("last_session"))
    return stats.join(F.broadcast(total), "rebalance_date").withColumn("presence", F.col("sessions") / F.col("n_sessions"))


def negotiability_index(stats: DataFrame, min_presence: float = 0.95, min_price: float = 1.0,
                        max_idle_days: int = 0) -> DataFrame:
    """sqrt(trade share times volume share) among the names that pass the filters."""
    alive = stats.filter((F.col("presence") >= min_presence) & (F.col("last_close") >= min_price)
                         & (F.col("last_date") >= F.date_sub("last_session", max_idle_days)))
    total = alive.groupBy("rebalance_date").agg(F.sum("trades").alias("_t"), F.sum("volume").alias("_v"))
    share = (F.col("trades") / F.col("_t")) * (F.col("volume") / F.col("_v"))
    return alive.join(F.broadcast(total), "rebalance_date").withColumn("in_index", F.sqrt(share)).drop("_t", "_v")


def universe_history(bars: DataFrame, sessions: DataFrame, size: int = 100, min_presence: float = 0.95,
                     min_price: float = 1.0, max_idle_days: int = 0) -> DataFrame:
    """Top names by negotiability at every rebalance date.

    Spark prunes ``row_number <= size`` per task before the shuffle, so only ``size`` rows per
    task and date reach the final ranking.
    """
    scored = negotiability_index(liquidity_stats(bars, sessions), min_presence, min_price, max_idle_days)
    w = Window.partitionBy("rebalance_date").orderBy(F.col("in_index").desc(), "sid")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= size)


def members_at(dates: DataFrame, universe: DataFrame) -> DataFrame:
    """Members in force at each date: those of the last rebalance on or before it.

    The rebalance in force is found on the two small date tables; members then join by equality.
    """
    rebs = universe.select("rebalance_date").distinct().withColumn("_k", F.lit(1))
    in_force = ts.asof(dates.withColumn("_k", F.lit(1)), rebs, ["_k"], "t", "rebalance_date", ["rebalance_date"])
    return in_force.drop("_k", "rebalance_date_matched").join(universe, "rebalance_date")


def universe_as_of(scd: DataFrame, as_of: Column) -> DataFrame:
    """Slowly changing membership: included on or before the date and not yet excluded."""
    start = F.coalesce(F.col("inclusion_date"), F.lit("1900-01-01").cast("date"))
    return scd.filter((start <= as_of) & (F.col("exclusion_date").isNull() | (F.col("exclusion_date") > as_of)))


def clean_bars(df: DataFrame, now: Column, settled: str = "18:30", opened: str = "10:00") -> DataFrame:
    """Drops incomplete interior bars; the last bar stays and carries the ``intraday`` flag."""
    w = ts.by_row()
    bad = F.greatest(*[(F.coalesce(F.col(c), F.lit(0.0)) <= 0).cast("int") for c in ("open", "high", "low", "volume")]) == 1
    clock = F.date_format(now, "HH:mm")
    open_now = (F.col("date") == F.to_date(now)) & (clock >= opened) & (clock < settled)
    return (df.withColumn("_last", F.lead("date").over(w).isNull()).withColumn("_bad", bad)
            .filter(F.col("_last") | ~F.col("_bad"))
            .withColumn("intraday", F.col("_last") & (F.col("_bad") | open_now)).drop("_last", "_bad"))


def fix_rate(series: DataFrame, value: str, keys: list[str], lo: float = 0.00005, hi: float = 0.002) -> DataFrame:
    """Policy rate in unknown unit to a daily decimal, judged by the median of the whole series.

    Above 1 the series is a yearly percentage; a median outside the plausible band switches to the
    other reading when that one is plausible.
    """
    daily = F.col(value) / 100
    yearly = F.pow(1 + F.col(value) / 100, F.lit(1 / 252)) - 1
    med = series.groupBy(*keys).agg(F.percentile(value, 0.5).alias("_m"))
    m_daily = F.col("_m") / 100
    m_yearly = F.pow(1 + F.col("_m") / 100, F.lit(1 / 252)) - 1
    first_is_yearly = F.col("_m") > 1.0
    chosen = F.when(first_is_yearly, m_yearly).otherwise(m_daily)
    other = F.when(first_is_yearly, m_daily).otherwise(m_yearly)
    switch = ~chosen.between(lo, hi) & other.between(lo, hi)
    use_yearly = first_is_yearly != switch
    return series.join(med, keys).withColumn("daily", F.when(use_yearly, yearly).otherwise(daily)).drop("_m")
