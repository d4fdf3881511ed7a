"""Evaluation queries: a recommendation is a customer's basket of a month."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from factorspark.catalog.q_portfolio import BW, basket_weights
from factorspark.catalog.registry import query
from factorspark.operators import evaluate as E
from factorspark.operators import events as V
from factorspark.session import cut_lineage, shared_dir
from factorspark.sources import loaders as O

KEYS = ["rec", "rec_date"]

EVAL_SQL = f"""
WITH {BW},
h0 AS (SELECT bw.*, rec_date + 60 AS d1, (SELECT arg_max(close, date) FROM bars b WHERE b.sid = bw.sid AND b.date <= bw.rec_date) AS entry,
  CASE WHEN sid % 17 <> 0 THEN (SELECT arg_max(close, date) FROM bars b WHERE b.sid = bw.sid AND b.date <= bw.rec_date + 60) END AS price FROM bw),
ev AS (SELECT s.sid, e.last_date_prior AS date, e.value, e.label FROM cash_events e JOIN securities s ON s.root = e.root AND s.kind = e.type),
dv AS (SELECT h0.rec, h0.rec_date, h0.sid, sum(value) AS dividends, sum(CASE WHEN label LIKE 'JRS%' THEN value ELSE 0 END) AS jcp FROM h0 JOIN ev ON ev.sid = h0.sid AND ev.date >= h0.rec_date AND ev.date < h0.d1 GROUP BY ALL),
h AS (SELECT h0.*, coalesce(dividends, 0) AS dividends, coalesce(jcp, 0) AS jcp FROM h0 LEFT JOIN dv USING (rec, rec_date, sid)),
hr AS (SELECT h.*, sector, CASE WHEN entry > 0 AND price IS NOT NULL THEN (price + dividends) / entry - 1 END AS ret FROM h JOIN securities USING (sid)),
bt AS (SELECT rec, rec_date, CASE WHEN count(ret) > 0 THEN sum(w * coalesce(ret, 0)) END AS gross, count(ret) AS priced, count(*) AS n,
  CASE WHEN count(ret) = count(*) THEN 'success' WHEN count(ret) > 0 THEN 'partial_data' ELSE 'no_history' END AS status FROM hr GROUP BY ALL)
"""


def events(t):
    pairs = t.securities.select("root", F.col("kind").alias("type"), "sid")
    return t.cash_events.join(pairs, ["root", "type"]).select("sid", F.col("last_date_prior").alias("date"), "value", "label")


def looked_up(t, pairs):
    """Prices at both ends and the dividends between them, of each security and day."""
    p = pairs.withColumn("d1", F.date_add("rec_date", 60))
    p = E.price_at(E.price_at(p, t.bars, "rec_date", "entry"), t.bars, "d1", "price")
    p = p.withColumn("price", F.when(F.col("sid") % 17 != 0, F.col("price")))
    return E.dividends_in_window(p, events(t), "rec_date", "d1")


def holdings(t, look=looked_up):
    """Weights with what ``look`` finds for their security and day.

    That is the same for all baskets that hold the security on the day, so each pair is looked up once; only then it meets the
    holdings, which are exchanged once. Weights are read for the pairs and for the holdings, and written out for that.
    """
    t.keep_bars("close")
    h = cut_lineage(basket_weights(t))
    p = look(t, h.select("sid", "rec_date").distinct()).withColumnsRenamed({"sid": "_sid", "rec_date": "_day"})
    return h.join(p, F.col("sid").eqNullSafe(F.col("_sid")) & (F.col("rec_date") == F.col("_day"))).drop("_sid", "_day")


def outcomes(t, pairs):
    """Return and sector of each security and day; not of a security that the master does not have."""
    ok = (F.col("entry") > 0) & F.col("price").isNotNull()
    return looked_up(t, pairs).withColumn("ret", F.when(ok, (F.col("price") + F.col("dividends")) / F.col("entry") - 1)).join(t.securities.select("sid", "sector"), "sid")


def with_returns(t):
    return holdings(t, outcomes)


@query("dividends_in_window", "rec:i rec_date:t sid:i dividends:11 jcp:11", EVAL_SQL + "SELECT * FROM h")
def _(t):
    return holdings(t)


@query("entry_prices", "rec:i rec_date:t sid:i entry:8", EVAL_SQL + """, q AS (SELECT sid, arg_max(open, date) AS quote FROM bars WHERE sid % 3 = 0 GROUP BY sid)
SELECT rec, rec_date, h0.sid, coalesce(quote, entry) AS entry FROM h0 LEFT JOIN q USING (sid)""")
def _(t):
    q = t.bars.filter("sid % 3 = 0").groupBy("sid").agg(F.max_by("open", "date").alias("quote"))
    return E.entry_prices(basket_weights(t), q, t.bars, "rec_date")


@query("backtest_holdings", "rec:i rec_date:t gross:5 priced:i n:i status:s", EVAL_SQL + "SELECT * FROM bt")
def _(t):
    from factorspark.operators.portfolio import backtest
    return backtest(holdings(t), KEYS)


@query("agg_attribution", "rec:i rec_date:t level:s sector:s sid:i weight:6 contribution:5 n:i", EVAL_SQL + """
SELECT rec, rec_date, 'name' AS level, sector, sid, w AS weight, w * coalesce(ret, 0) AS contribution, 1 AS n FROM hr
UNION ALL SELECT rec, rec_date, 'sector', sector, NULL, sum(w), sum(w * coalesce(ret, 0)), count(*) FROM hr GROUP BY rec, rec_date, sector
UNION ALL SELECT rec, rec_date, 'total', NULL, NULL, sum(w), sum(w * coalesce(ret, 0)), count(*) FROM hr GROUP BY rec, rec_date""")
def _(t):
    return E.attribution(with_returns(t), KEYS)


RECORD_SQL = EVAL_SQL + """,
ix AS (SELECT rec, rec_date, (SELECT arg_max(close, date) FROM index_close i WHERE i.date <= rec_date + 60) / (SELECT arg_max(close, date) FROM index_close i WHERE i.date <= rec_date) - 1 AS index_ret FROM bt),
rc AS (SELECT rec, tanh(gross) / 5 AS ret, tanh(index_ret) / 5 AS index_ret FROM bt JOIN ix USING (rec, rec_date) WHERE status = 'success')
"""


@query("agg_track_record", "rec:i n_periods:i cum_portfolio:5 cum_index:5 win_rate:6 avg_alpha:6", RECORD_SQL + """
SELECT rec, count(*) AS n_periods, product(1 + ret) - 1 AS cum_portfolio, product(1 + index_ret) - 1 AS cum_index, avg(CASE WHEN ret - index_ret > 0 THEN 1.0 ELSE 0 END) AS win_rate, avg(ret - index_ret) AS avg_alpha FROM rc GROUP BY rec HAVING count(index_ret) = count(*)""")
def _(t):
    from factorspark.operators import timeseries as ts
    from factorspark.operators.portfolio import backtest

    bt = backtest(holdings(t), KEYS)
    ix = t.index_close.withColumn("_k", F.lit(1)).select("_k", "date", "close")
    days = bt.select("rec_date").distinct().withColumn("d1", F.date_add("rec_date", 60)).withColumn("_k", F.lit(1))
    a = ts.asof(days, ix, ["_k"], "rec_date", "date", ["close"]).withColumnRenamed("close", "i0").drop("date_matched")
    b = ts.asof(a, ix, ["_k"], "d1", "date", ["close"]).select("rec_date", (F.col("close") / F.col("i0") - 1).alias("index_ret"))
    rec = bt.join(b, "rec_date").select("rec", "status", F.lit(60).alias("period_days"), (F.tanh("gross") / 5).alias("ret"), (F.tanh("index_ret") / 5).alias("index_ret"))
    bad = rec.filter("status = 'success' and index_ret is null").select("rec").distinct()
    return E.track_record(rec.join(bad, "rec", "left_anti"), ["rec"])


WF_SQL = f"""
WITH {BW}, mx AS (SELECT max(sno) AS m FROM sessions),
en AS (SELECT rec * 1000000 + year(rec_date) * 100 + month(rec_date) AS id, rec % 5 AS grp, rec, rec_date, (SELECT min(sno) FROM sessions s WHERE s.date >= rec_date) AS i0 FROM (SELECT DISTINCT rec, rec_date FROM bw)),
wi AS (SELECT en.*, h, i0 + h AS i1 FROM en, (VALUES (5), (20), (60)) v(h), mx WHERE i0 + h <= m),
pr AS (SELECT wi.id, wi.grp, wi.h, wi.i0, wi.i1, bw.w, a.close AS p0, (SELECT arg_max(close, sno) FROM sbars b WHERE b.sid = bw.sid AND b.sno <= wi.i1) AS p1
  FROM wi JOIN bw USING (rec, rec_date) LEFT JOIN sbars a ON a.sid = bw.sid AND a.sno = wi.i0),
po AS (SELECT id, grp, h, i0, i1, sum(w * coalesce(p1 / p0 - 1, 0)) AS port, count(*) - count(p0) AS n_missing FROM pr GROUP BY ALL),
lv AS (SELECT sno, close, product(1 + cdi) OVER (ORDER BY sno) AS c FROM index_close JOIN cdi USING (sno)),
wf AS (SELECT po.*, b.close / a.close - 1 AS index_ret, b.c / a.c - 1 AS cdi_ret, port - (b.close / a.close - 1) AS alpha, port - (b.c / a.c - 1) AS excess FROM po JOIN lv a ON a.sno = i0 JOIN lv b ON b.sno = i1)
"""


def dated_weights(t):
    """Weights with an id of customer and month, read for the runs and for the holdings."""
    return cut_lineage(basket_weights(t).withColumn("id", F.col("rec") * 1000000 + F.year("rec_date") * 100 + F.month("rec_date")).select("id", "rec_date", "sid", "w"))


def wf(t):
    t.keep_bars("close")
    b = dated_weights(t)
    runs = b.select("id", F.col("rec_date").cast("timestamp").alias("run_at")).distinct()
    entries = V.entry_session(runs, t.sessions).select(F.col("id").alias("rec"), "entry_sno")
    return E.walk_forward(entries, b.select(F.col("id").alias("rec"), "sid", "w"), t.sbars, t.sessions, t.index_close, t.cdi)


@query("walk_forward", "rec:i h:i entry_sno:i port:5 n_missing:i index_ret:5 cdi_ret:6 alpha:5", WF_SQL + "SELECT id AS rec, h, i0 AS entry_sno, port, n_missing, index_ret, cdi_ret, alpha FROM wf")
def _(t):
    return wf(t)


@query("agg_walk_forward_summary", "grp:i h:i n:i mean_return:5 median_return:5 mean_alpha:5 hit_rate:6 n_eff:4 n_own:i sharpe:5", WF_SQL + """,
dd AS (SELECT grp, h, i0, avg(port) AS port, avg(alpha) AS alpha, avg(excess) AS excess FROM wf GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY grp, h ORDER BY i0) - 1 AS i, CAST(greatest(1, ceil(h / 5)) AS INT) AS step FROM dd)
SELECT grp, h, count(*) AS n, avg(port) AS mean_return, quantile_cont(port, 0.5) AS median_return, avg(alpha) AS mean_alpha, avg(CASE WHEN alpha > 0 THEN 1.0 ELSE 0 END) AS hit_rate, count(*) / max(step) AS n_eff,
 count(*) FILTER (i % step = 0) AS n_own, avg(excess) FILTER (i % step = 0) / stddev_samp(excess) FILTER (i % step = 0) * sqrt(252 / h) AS sharpe FROM o GROUP BY grp, h""")
def _(t):
    p = wf(t).withColumn("grp", F.floor(F.col("rec") / 1000000) % 5)
    p = p.groupBy("grp", "h", "entry_sno").agg(*[F.avg(c).alias(c) for c in ("port", "alpha", "excess")])
    return E.walk_forward_summary(p, ["grp"], "entry_sno")


NAV_SQL = """
WITH r AS (SELECT sid, date, sno, close / lag(close) OVER w - 1 AS x, sno - lag(sno) OVER w AS gap FROM sbars WINDOW w AS (PARTITION BY sid ORDER BY date)),
rr AS (SELECT sid, date, CASE WHEN gap = 1 THEN tanh(x) / 20 END AS ret FROM r),
bk AS (SELECT rec % 5 AS grp, rec_date, sid, sum(value) AS value FROM baskets GROUP BY ALL), ds AS (SELECT DISTINCT grp, rec_date FROM bk),
inf AS (SELECT g.grp, s.date, (SELECT max(rec_date) FROM ds WHERE ds.grp = g.grp AND ds.rec_date <= s.date) AS rec_date FROM sessions s, (SELECT DISTINCT grp FROM ds) g),
hh AS (SELECT inf.grp, inf.date, inf.rec_date, bk.sid, bk.value / sum(bk.value) OVER (PARTITION BY inf.grp, inf.date) AS w, rr.ret FROM inf JOIN bk USING (grp, rec_date) LEFT JOIN rr ON rr.sid = bk.sid AND rr.date = inf.date),
pp AS (SELECT grp, date, rec_date, CASE WHEN count(ret) > 0 THEN sum(w * coalesce(ret, 0)) END AS port_ret, count(*) - count(ret) AS n_missing FROM hh GROUP BY ALL),
ii AS (SELECT date, tanh(close / lag(close) OVER (ORDER BY sno) - 1) / 20 AS index_ret FROM index_close),
pts AS (SELECT pp.*, index_ret, CASE WHEN day(date) % 7 <> 0 THEN cdi END AS cdi_ret, 0.4 * port_ret + 0.3 * coalesce(CASE WHEN day(date) % 7 <> 0 THEN cdi END, 0) + 0.3 * coalesce(index_ret, 0) AS blended FROM pp JOIN ii USING (date) JOIN cdi USING (date))
"""


def nav_points(t):
    """Per group of customers the basket in force at each session and its return of the day."""
    from factorspark.operators import timeseries as ts

    w = ts.by_row()
    t.keep_bars("close")
    gap = F.col("sno") - F.lag("sno").over(w)
    r = t.sbars.select("sid", "date", F.when(gap == 1, F.tanh(ts.returns("close", w)) / 20).alias("ret")).filter("ret is not null")
    bk = t.baskets.groupBy((F.col("rec") % 5).alias("grp"), "rec_date", "sid").agg(F.sum("value").alias("w"))
    bk = cut_lineage(bk)
    dates = bk.select("grp", "rec_date").distinct()
    days = t.sessions.agg(F.collect_list("date").alias("ds"))
    grid = dates.select("grp").distinct().join(F.broadcast(days)).select("grp", F.explode("ds").alias("date"))
    force = ts.asof(grid, dates, ["grp"], "date", "rec_date", ["rec_date"]).drop("rec_date_matched").filter("rec_date is not null")
    # a basket's names times its sessions would be a dense grid: whole sleeves are summed once, and only returns that exist meet their names
    sleeves = force.join(bk.filter("w > 0").groupBy("grp", "rec_date").agg(F.sum("w").alias("_w"), F.count("*").alias("_all")), ["grp", "rec_date"])
    # a return travels once for all groups; where it meets a basket that its group doesn't hold on that day, there is no sleeve for it
    rows = r.join(force.select("date", "rec_date").distinct(), "date").join(bk, ["rec_date", "sid"])
    port = E.weighted_return(rows, ["grp", "date", "rec_date"], sleeves)
    wi = Window.partitionBy(F.lit(1)).orderBy("sno")
    ix = t.index_close.select("date", (F.tanh(ts.returns("close", wi)) / 20).alias("index_ret"))
    cdi = t.cdi.select("date", F.when(F.dayofmonth("date") % 7 != 0, F.col("cdi")).alias("cdi_ret"))
    pts = port.join(ix, "date").join(cdi, "date")
    blend = 0.4 * F.col("port_ret") + 0.3 * F.coalesce("cdi_ret", F.lit(0.0)) + 0.3 * F.coalesce("index_ret", F.lit(0.0))
    return pts.withColumn("blended", blend)


@query("nav_curve_points", "grp:i date:t rec_date:t port_ret:7 n_missing:i index_ret:7 cdi_ret:12 blended:7", NAV_SQL + "SELECT * FROM pts")
def _(t):
    return nav_points(t)


SUMM_SQL = NAV_SQL + """,
lc AS (SELECT *, last_value(cdi_ret IGNORE NULLS) OVER (PARTITION BY grp ORDER BY date) AS eff, (port_ret - index_ret) * 100 AS a FROM pts),
sm AS (SELECT grp, count(*) AS n_obs, product(1 + coalesce(port_ret, 0)) - 1 AS p, product(1 + coalesce(index_ret, 0)) - 1 AS i, product(1 + coalesce(eff, 0)) - 1 AS c,
  CASE WHEN count(a) >= 10 THEN stddev_samp(a) ELSE 1.2 END AS noise_pp, arg_max(a, date) AS last_a FROM lc GROUP BY grp)
SELECT grp, n_obs, (p - i) * 100 AS alpha_index_pp, (p - c) * 100 AS alpha_cdi_pp, noise_pp, CASE WHEN abs(last_a) / noise_pp < 1 THEN 'noise' WHEN abs(last_a) / noise_pp < 2 THEN 'notable' ELSE 'strong' END AS verdict FROM sm"""


@query("nav_summary", "grp:i n_obs:i alpha_index_pp:2 alpha_cdi_pp:2", SUMM_SQL)
def _(t):
    return E.nav_summary(nav_points(t), ["grp"])


@query("noise_band", "grp:i noise_pp:5 verdict:s", SUMM_SQL)
def _(t):
    return E.nav_summary(nav_points(t), ["grp"])


@query("cumulative_since_entry", "rec:i rec_date:t cum:5", f"""
WITH lb AS (SELECT rec, max(rec_date) AS rec_date FROM baskets GROUP BY rec), h AS (SELECT b.rec, b.rec_date, b.sid FROM baskets b JOIN lb USING (rec, rec_date)),
e AS (SELECT h.*, (SELECT arg_max(close, date) FROM bars WHERE bars.sid = h.sid AND bars.date <= h.rec_date) AS entry FROM h), c AS (SELECT sid, arg_max(close, date) AS last FROM bars GROUP BY sid)
SELECT rec, rec_date, avg(last / entry - 1) AS cum FROM e JOIN c USING (sid) GROUP BY ALL""")
def _(t):
    last = t.baskets.groupBy("rec").agg(F.max("rec_date").alias("rec_date"))
    h = E.price_at(t.baskets.join(last, KEYS).select(*KEYS, "sid"), t.bars, "rec_date", "entry")
    now = t.bars.groupBy("sid").agg(F.max_by("close", "date").alias("last"))
    return h.join(now, "sid").groupBy(*KEYS).agg(F.avg(F.col("last") / F.col("entry") - 1).alias("cum"))


def span(df, date, days=0):
    """First and last day of a column, the last moved on by some days; one row."""
    return df.agg(F.min(date).alias("a"), F.date_add(F.max(date), days).alias("b")).first()


def loaded(t, kind, rows, start, end):
    """Rows by way of a registered loader of monthly files."""
    O.register(t.spark)
    return O.load(t.spark, kind, start, end, path=O.write_monthly(rows, shared_dir(t.spark, kind)))


def wf_loaded(t):
    """Walk-forward with prices and benchmark returns from loaders instead of tables."""
    t.keep_bars("close")
    b = dated_weights(t)
    first = span(b, "rec_date")["a"]
    last = span(t.sessions, "date")["b"]
    runs = b.select("id", F.col("rec_date").cast("timestamp").alias("run_at")).distinct()
    entries = V.entry_session(runs, t.sessions).select(F.col("id").alias("rec"), "entry_sno")
    sno = t.sessions.select("date", "sno")
    prices = loaded(t, "prices", t.bars.select("sid", "date", "close"), first, last).join(sno, "date").select("sid", "sno", "close")
    w = Window.partitionBy(F.lit(1)).orderBy("sno")
    daily = t.index_close.withColumn("index_ret", F.col("close") / F.lag("close").over(w) - 1).join(t.cdi.select("sno", "cdi"), "sno")
    bench = loaded(t, "benchmarks", daily.select("date", "index_ret", "cdi"), first, last).join(sno, "date")
    # a session's own return is in the level at its close, so a window from entry to exit holds the returns after the entry
    level = bench.select("sno", F.product(1 + F.coalesce("index_ret", F.lit(0.0))).over(w).alias("close"))
    return E.walk_forward(entries, b.select(F.col("id").alias("rec"), "sid", "w"), prices, t.sessions, level, bench.select("sno", "cdi"))


@query("price_loader", "rec:i h:i entry_sno:i port:5 n_missing:i", WF_SQL + "SELECT id AS rec, h, i0 AS entry_sno, port, n_missing FROM wf")
def _(t):
    return wf_loaded(t)


@query("bench_loader", "rec:i h:i index_ret:5 cdi_ret:6 alpha:5", WF_SQL + "SELECT id AS rec, h, index_ret, cdi_ret, alpha FROM wf")
def _(t):
    return wf_loaded(t)


@query("dividend_fetcher", "rec:i rec_date:t sid:i dividends:11 jcp:11", EVAL_SQL + "SELECT * FROM h")
def _(t):
    h = basket_weights(t).withColumn("d1", F.date_add("rec_date", 60))
    days = span(h, "rec_date", 59)  # cum dates from the entry up to the day before the exit
    return E.dividends_in_window(h, loaded(t, "dividends", events(t), days["a"], days["b"]), "rec_date", "d1")
