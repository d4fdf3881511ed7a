"""Monthly factor panel: one row per month end and member, for all months in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.scalars import ADV_REFERENCE, friction, sane
from factorspark.operators import filings as G
from factorspark.operators import timeseries as ts
from factorspark.operators import xsection as X

# Factor, a-priori direction; pillars with weight and direction.
FACTORS = {"EY": 1, "BP": 1, "EBIT_EV": 1, "MOM": 1, "REV": -1, "VOL": -1, "BETA": -1, "ROE": 1, "GP": 1, "ACC": -1,
           "SIZE": -1, "LIQ": -1}
FUND = {"EY": (0.20, 1), "BP": (0.15, 1), "ROE": (0.25, 1), "ROIC": (0.20, 1), "ND_EBITDA": (0.10, -1), "dy": (0.10, 1),
        "SIZE": (0.05, -1), "rev_growth": (0.08, 1), "asset_growth": (0.05, -1)}
MOM = {"ret3": (0.30, 1), "ret6": (0.40, 1), "MOM": (0.30, 1)}
QUAL = {"vol180": (0.40, -1), "BETA": (0.35, -1), "adv30": (0.25, 1)}
PILLARS = {"fund_z": (FUND, True), "mom_z": (MOM, False), "qual_z": (QUAL, False)}
COMPOSITE = (0.45, 0.30, 0.25)
MIN_SESSIONS = 261


def price_signals(bars: DataFrame, index: DataFrame, probes: DataFrame, fill: int = 0, min_beta: int = 150) -> DataFrame:
    """Momentum, volatility, beta, volume and dividend signals of each probe, as of ``prev_sno``.

    ``bars``: sid, sno, date, close, tr_close, volume, ret, dividend, where ``tr_close`` is adjusted for splits and dividends and ``ret``
    its return, so that a split is no crash; ``px`` and ``dy`` take the price as quoted. ``index``: sno, close; ``probes``: t, t_prev,
    prev_sno, sid. Probes are sorted in among the bars and read frames that range over session
    ordinals: one shuffle by security serves every signal, nothing is densified and no date is
    looped over. Moments come from running sums, whose frames only grow.
    """
    wi = Window.partitionBy("_k").orderBy("sno")
    idx = index.withColumn("_k", F.lit(1)).withColumn("m", F.col("close") / F.lag("close").over(wi) - 1)
    idx = ts.rolling_moments(idx, "m", wi, 252, "_m").select("sno", "m", (F.col("_m_std") * F.col("_m_std")).alias("m_var"))
    rows = (bars.join(idx, "sno").select("sid", "sno", "date", "close", "tr_close", "volume", "ret", "dividend", "m",
                                         F.col("close").alias("px_own"))
            .unionByName(probes.join(idx.select("sno", "m_var"), probes.prev_sno == F.col("sno"))
                         .select("sid", "sno", F.col("t_prev").alias("date"), "t", "m_var"), allowMissingColumns=True))
    w = Window.partitionBy("sid").orderBy("sno")
    past = w.rangeBetween(Window.unboundedPreceding, 0)

    def window_sum(x: Column, n: int) -> Column:
        x, before = sane(x.cast("double")), w.rangeBetween(Window.unboundedPreceding, -n)
        return F.coalesce(F.sum(x).over(past), F.lit(0.0)) - F.coalesce(F.sum(x).over(before), F.lit(0.0))

    def count(x: Column, n: int) -> Column:
        x = sane(x.cast("double"))
        return F.count(x).over(past) - F.count(x).over(w.rangeBetween(Window.unboundedPreceding, -n))

    def vol(n: int) -> Column:
        c, s, q = count(F.col("ret"), n), window_sum(F.col("ret"), n), window_sum(F.col("ret") * F.col("ret"), n)
        return F.when(c > 1, F.sqrt(F.greatest((q - s * s / c) / (c - 1), F.lit(0.0)) * 252))

    r, m = F.col("ret"), F.col("m")
    mm = F.when(r.isNotNull(), m)
    c, sr, sm, srm = count(r, 252), window_sum(r, 252), window_sum(mm, 252), window_sum(r * m, 252)
    cov = F.when(c > min_beta, (srm - sr * sm / c) / (c - 1))
    days = Window.partitionBy("sid").orderBy("_day").rangeBetween(-364, 0)
    at = {k: ts.at_session("tr_close", w, k, fill) for k in (0, 21, 63, 126, 252)}
    vols = {n: count(F.col("volume"), n) for n in (63, 30)}
    out = rows.withColumn("_day", F.unix_date("date")).select(
        "t", "sid", "sno", "m_var", ts.at_session("close", w, 0, fill).alias("px"), (at[21] / at[252] - 1).alias("MOM"), (at[0] / at[21] - 1).alias("REV"),
        (at[21] / at[63] - 1).alias("ret3"), (at[21] / at[126] - 1).alias("ret6"), vol(252).alias("VOL"), vol(180).alias("vol180"),
        vol(126).alias("vol126"), cov.alias("_cov"),
        *[F.when(vols[n] > 0, window_sum(F.col("volume"), n) / vols[n]).alias(a) for n, a in ((63, "LIQ"), (30, "adv30"))],
        F.sum("dividend").over(days).alias("_div"))
    return (out.filter("t is not null").withColumn("BETA", F.col("_cov") / F.when(F.col("m_var") > 0, F.col("m_var")))
            .withColumn("dy", F.coalesce("_div", F.lit(0.0)) / F.when(F.col("px") != 0, F.col("px"))).drop("_cov", "m_var", "_div", "sno"))


def forward_returns(bars: DataFrame, months: DataFrame, probes: DataFrame, fill: int = 0) -> DataFrame:
    """Return, adjusted as ``tr_close`` is, from the month end to the last price of the next month; 0 without a trade there.

    Bars are reduced to one row per security and month first; both ends are equality joins.
    """
    m = bars.groupBy("sid", F.trunc("date", "month").alias("month")).agg(F.max("sno").alias("_s"), F.max_by("tr_close", "sno").alias("_c"))
    here = probes.join(months.select("t", "month", "t_sno", "t_next"), "t").filter("t_next is not null")
    start = m.select("sid", "month", "_s", "_c")
    nxt = m.select("sid", F.add_months("month", -1).alias("month"), F.col("_c").alias("_next"))
    j = here.join(start, ["sid", "month"], "left").join(nxt, ["sid", "month"], "left")
    base = F.when(F.col("t_sno") - F.col("_s") <= fill, F.col("_c"))
    return j.select("t", "sid", F.when(F.col("_next").isNull(), 0.0).otherwise(F.col("_next") / base - 1).alias("fwd"))


def derive_ratios(p: DataFrame) -> DataFrame:
    """Value, quality and size ratios from the linked fundamentals; null where they have no meaning."""
    c = F.col

    def z(col):
        return F.coalesce(c(col), F.lit(0.0))

    def pos(x):
        return F.when(x > 0, x)

    cap = pos(c("mcap"))
    nonfin = ~F.coalesce(c("is_fin"), F.lit(False))
    ic = z("equity") + z("debt") - z("cash")
    ebitda = c("ebit") + z("dna")
    return (p.withColumn("EY", c("ni") / cap).withColumn("BP", c("equity") / cap)
            .withColumn("EBIT_EV", F.when(nonfin, c("ebit") / pos(cap + z("debt") - z("cash"))))
            .withColumn("ROE", c("ni") / pos(c("equity"))).withColumn("GP", F.when(nonfin, c("gross_profit") / pos(c("assets"))))
            .withColumn("ACC", F.when(nonfin, (c("ni") - c("ocf")) / pos(c("assets")))).withColumn("SIZE", F.log(cap))
            .withColumn("ROIC", F.when(nonfin, c("ebit") * 0.66 / pos(ic)))
            .withColumn("ND_EBITDA", F.when(nonfin, (z("debt") - z("cash")) / pos(ebitda))).withColumn("PE", cap / pos(c("ni")))
            .withColumn("is_fin", F.coalesce("is_fin", F.lit(False))).withColumn("sector", F.coalesce("sector", F.lit("?"))))


def links_at(members: DataFrame, listings: DataFrame, segments: DataFrame, financial: str) -> DataFrame:
    """Issuer and sector of each member as they hold at its date: t, sid, issuer, sector, is_fin.

    ``listings``: sid, issuer, start, finish, so that a ticker can pass to another issuer, or be listed again after a gap;
    ``segments``: issuer, year, segment, each in force until the issuer's next one.
    """
    linked = ts.valid_at(members.select("t", "sid"), listings, ["sid"], "t", ["issuer"])
    ranges = ts.until_next(segments.select("issuer", F.make_date("year", F.lit(1), F.lit(1)).alias("start"), F.col("segment").alias("sector")), ["issuer"], "start")
    return ts.valid_at(linked, ranges, ["issuer"], "t", ["sector"]).withColumn("is_fin", F.coalesce(F.col("sector") == financial, F.lit(False)))


def factor_panel(bars: DataFrame, index: DataFrame, months: DataFrame, members: DataFrame, docs: DataFrame, doc_values: list[str],
                 links: DataFrame, fill: int = 0, min_beta: int = 150) -> DataFrame:
    """Signals known before each month end, linked fundamentals and the next month's return.

    ``members``: t, sid in force; ``links``: t, sid, issuer, sector, is_fin as they hold at t, null where none does, or without t if they never
    change; ``docs``: filings with ``available_from``. Months with less than 261 sessions of history are left out.
    """
    dates = months.filter(F.col("prev_sno") >= MIN_SESSIONS)
    probes = members.select("t", "sid").join(dates.select("t", "t_prev", "prev_sno"), "t")
    sig = price_signals(bars, index, probes, fill, min_beta)
    fwd = forward_returns(bars, months, probes.select("t", "sid"), fill)
    linked = probes.select("t", "t_prev", "sid").join(links, [c for c in ("t", "sid") if c in links.columns], "left")
    fund = G.as_of(linked.select("t", "sid", "issuer", F.col("t_prev").alias("as_of")), docs, doc_values)
    keys = ["t", "sid"]
    return (linked.join(sig, keys).join(fwd, keys).join(fund.drop("issuer", "as_of", "available_from").withColumnRenamed("dt_refer", "doc_ref"), keys, "left"))


def drop_unpriced(panel: DataFrame, events: DataFrame) -> DataFrame:
    """Forward return to null where a known unpriced event falls into (t, next t].

    ``events``: sid, event_date — a short hand-kept list; it is joined on the security.
    """
    nxt = panel.select("t").distinct().withColumn("_next", F.lead("t").over(Window.orderBy("t")))
    p = panel.join(nxt, "t")
    hits = (p.select("t", "sid", "_next").join(events, "sid")
            .filter((F.col("t") < F.col("event_date")) & (F.col("_next").isNull() | (F.col("_next") >= F.col("event_date"))))
            .select("t", "sid").distinct().withColumn("_hit", F.lit(True)))
    return p.drop("_next").join(hits, ["t", "sid"], "left").withColumn(
        "fwd", F.when(F.col("_hit").isNull(), F.col("fwd"))).drop("_hit")


def study_filter() -> Column:
    """The study's filters. A comparison with a missing value is false, so it only fails the
    volume rule."""
    def yes(cond):
        return F.coalesce(cond, F.lit(False))

    c = F.col
    return (yes(c("adv30") >= 5_000_000) & ~yes(~c("is_fin") & (c("ND_EBITDA") > 5)) & ~yes((c("ni") < 0) & (c("ROE") < -0.05))
            & ~yes(c("PE") > 80) & ~yes(c("ROE") < -0.50))


def factor_rows(panel: DataFrame, factors: dict, keep: list[str]) -> DataFrame:
    """Panel to rows (t, sid, kept columns, factor, x, weight, dir)."""
    def value(f):
        x = F.log(F.greatest(F.col(f), F.lit(1.0))) if f in ("LIQ", "adv30") else F.col(f)
        x = F.when(F.col(f).isNotNull(), x).cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)

    spec = {f: (v if isinstance(v, tuple) else (1.0, v)) for f, v in factors.items()}
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), value(f).alias("x"), F.lit(float(w)).alias("weight"),
                                        F.lit(float(d)).alias("dir")) for f, (w, d) in spec.items()]))
    return panel.select("t", "sid", *keep, rows.alias("_r")).select("t", "sid", *keep, "_r.*")


def _weighted(rows: DataFrame, out: str) -> DataFrame:
    s = F.sum(F.when(F.col("z").isNotNull(), F.col("weight") * F.col("z"))) / F.sum(F.when(F.col("z").isNotNull(), F.col("weight")))
    return rows.groupBy("t", "sid").agg(s.alias(out))


def pillar_scores(panel: DataFrame) -> DataFrame:
    """Three pillars as weighted means of the available factor z-scores."""
    out = None
    for name, (factors, sectoral) in PILLARS.items():
        rows = factor_rows(panel, factors, ["sector"])
        z = (X.sector_adaptive_z(rows, ["t", "factor"], "sector", "x", "dir") if sectoral
             else X.global_z(rows, ["t", "factor"], "x", "dir"))
        part = _weighted(z, name)
        out = part if out is None else out.join(part, ["t", "sid"])
    return out


def composite(pillars: DataFrame, w=COMPOSITE, out: str = "score") -> DataFrame:
    """Weighted mean of the available pillars; ``w`` holds numbers or columns."""
    parts = list(zip(PILLARS, w))
    num = sum(F.coalesce(F.col(p), F.lit(0.0)) * x for p, x in parts)
    den = sum(F.when(F.col(p).isNotNull(), F.lit(1.0)).otherwise(0.0) * x for p, x in parts)
    return pillars.withColumn(out, num / F.when(den > 0, den))


def mom_value(panel: DataFrame, out: str = "score") -> DataFrame:
    """Half momentum z, half the mean of the earnings yield and book yield z."""
    rows = X.global_z(factor_rows(panel, {"EY": 1, "BP": 1, "MOM": 1}, []), ["t", "factor"], "x", "dir")
    g = rows.groupBy("t", "sid").agg(F.avg(F.when(F.col("factor") != "MOM", F.col("z"))).alias("v"),
                                     F.max(F.when(F.col("factor") == "MOM", F.col("z"))).alias("m"))
    return g.select("t", "sid", (0.5 * F.col("m") + 0.5 * F.col("v")).alias(out))


def costs(panel: DataFrame) -> DataFrame:
    """Trading cost of each panel member; unknown volume pays the base rate."""
    return panel.select("t", "sid", friction(F.coalesce("adv30", F.lit(ADV_REFERENCE)), "floor").alias("friction"))


def quintile_legs(scores: DataFrame, panel: DataFrame, variant: list[str], score: str = "score") -> DataFrame:
    """Equal-weight top and bottom quintile of each month and variant (leg Q5 / Q1)."""
    b = X.quintiles(scores.filter(F.col(score).isNotNull()), [*variant, "t"], score, "sid").filter("bucket in (1, 5)")
    b = b.withColumn("leg", F.concat(F.lit("Q"), F.col("bucket").cast("string")))
    n = b.groupBy(*variant, "t", "leg").agg((1 / F.count("*")).alias("w"))
    return b.join(n, [*variant, "t", "leg"]).join(panel.select("t", "sid", "fwd"), ["t", "sid"]).select(*variant, "leg", "t", "sid", "w", "fwd")
