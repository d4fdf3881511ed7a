"""Time-series window queries."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorspark.catalog.registry import query
from factorspark.operators import regimes as R
from factorspark.operators import timeseries as ts

GAPPY_SQL = "SELECT sid, date, sno, CASE WHEN trades < 2 OR sid % 4 <> 0 THEN close END AS close FROM sbars"


def gappy(t):
    """Bars whose close is missing on some busy days, to exercise the fill modes."""
    return t.sbars.select("sid", "date", "sno", F.when((F.col("trades") < 2) | (F.col("sid") % 4 != 0), F.col("close")).alias("close"))


@query("win_returns", "sid:i date:t ret:6 logret:6 ret_ffill:6", f"""
WITH g AS ({GAPPY_SQL}),
f AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY sid ORDER BY date ROWS UNBOUNDED PRECEDING) AS now,
  last_value(close IGNORE NULLS) OVER (PARTITION BY sid ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  lag(close) OVER (PARTITION BY sid ORDER BY date) AS prev FROM g)
SELECT sid, date, close / prev - 1 AS ret, ln(close / prev) AS logret, now / before - 1 AS ret_ffill FROM f""")
def _(t):
    w = ts.by_row()
    return gappy(t).select("sid", "date", ts.returns("close", w).alias("ret"), ts.returns("close", w, log=True).alias("logret"),
                           ts.returns("close", w, fill="ffill").alias("ret_ffill"))


@query("win_ffill_limit", "sid:i date:t fill3:8 fill5:8 fill:8", f"""
WITH g AS ({GAPPY_SQL})
SELECT sid, date, last_value(close IGNORE NULLS) OVER (PARTITION BY sid ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS fill3,
 last_value(close IGNORE NULLS) OVER (PARTITION BY sid ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS fill5,
 last_value(close IGNORE NULLS) OVER (PARTITION BY sid ORDER BY date ROWS UNBOUNDED PRECEDING) AS fill FROM g""")
def _(t):
    w = ts.by_row()
    return gappy(t).select("sid", "date", ts.ffill("close", w, 3).alias("fill3"), ts.ffill("close", w, 5).alias("fill5"),
                           ts.ffill("close", w).alias("fill"))


TRAIL_SQL = """
WITH g AS (SELECT sid, date, sno, close,
  last_value(close) OVER (PARTITION BY sid ORDER BY sno RANGE BETWEEN 41 PRECEDING AND 21 PRECEDING) AS p21,
  last_value(close) OVER (PARTITION BY sid ORDER BY sno RANGE BETWEEN 83 PRECEDING AND 63 PRECEDING) AS p63,
  last_value(close) OVER (PARTITION BY sid ORDER BY sno RANGE BETWEEN 272 PRECEDING AND 252 PRECEDING) AS p252,
  last_value(close) OVER (PARTITION BY sid ORDER BY sno RANGE BETWEEN 271 PRECEDING AND 251 PRECEDING) AS p251,
  last_value(CASE WHEN sno <= 2 THEN close END IGNORE NULLS) OVER (PARTITION BY sid ORDER BY sno) AS p2 FROM sbars)
"""


@query("win_trailing_return", "sid:i date:t mom:6 rev:6 ret3:6 live12:6", TRAIL_SQL + """
SELECT sid, date, p21 / p252 - 1 AS mom, close / p21 - 1 AS rev, p21 / p63 - 1 AS ret3,
 CASE WHEN sno >= 23 THEN p21 / CASE WHEN sno > 252 THEN p251 ELSE p2 END - 1 END AS live12 FROM g""")
def _(t):
    w = Window.partitionBy("sid").orderBy("sno")
    return t.sbars.select(
        "sid", "date", ts.trailing_return("close", w, 252, 21, 20).alias("mom"), ts.trailing_return("close", w, 21, 0, 20).alias("rev"),
        ts.trailing_return("close", w, 63, 21, 20).alias("ret3"),
        ts.live_trailing_return("close", "sno", w, 252, 21, 20).alias("live12"))


@query("win_alpha", "sid:i date:t alpha:6", TRAIL_SQL + """,
ix AS (SELECT date, lag(close, 21) OVER (ORDER BY sno) / lag(close, 252) OVER (ORDER BY sno) - 1 AS r FROM index_close)
SELECT sid, date, p21 / p252 - 1 - ix.r AS alpha FROM g JOIN ix USING (date)""")
def _(t):
    w = Window.partitionBy("sid").orderBy("sno")
    wi = Window.partitionBy(F.lit(1)).orderBy("sno")
    index = t.index_close.select("date", ts.trailing_return("close", wi, 252, 21).alias("index_ret"))
    stock = t.sbars.select("sid", "date", ts.trailing_return("close", w, 252, 21, 20).alias("ret"))
    return stock.join(index, "date").select("sid", "date", (F.col("ret") - F.col("index_ret")).alias("alpha"))


@query("win_realized_vol", "sid:i date:t vol252:5 vol180:5 vol126:5", """
WITH r AS (SELECT sid, date, close / lag(close) OVER (PARTITION BY sid ORDER BY date) - 1 AS r FROM bars)
SELECT sid, date,
 CASE WHEN count(r) OVER a >= 30 THEN stddev_samp(r) OVER a * sqrt(252) END AS vol252,
 CASE WHEN count(r) OVER b >= 30 THEN stddev_samp(r) OVER b * sqrt(252) END AS vol180,
 CASE WHEN count(r) OVER c >= 30 THEN stddev_samp(r) OVER c * sqrt(252) END AS vol126 FROM r
WINDOW a AS (PARTITION BY sid ORDER BY date ROWS 251 PRECEDING), b AS (PARTITION BY sid ORDER BY date ROWS 179 PRECEDING), c AS (PARTITION BY sid ORDER BY date ROWS 125 PRECEDING)""")
def _(t):
    w = ts.by_row()
    df = t.bars.select("sid", "date", ts.returns("close", w).alias("r"))
    for n in (252, 180, 126):
        df = ts.rolling_vol(df, "r", w, n, f"vol{n}")
    return df


# money is summed in cents and divided half up in whole numbers, as engines round halves of doubles either way
@query("win_rolling_adv", "sid:i date:t adv63:4 adv30:4", """
SELECT sid, date, (200 * CAST(round(sum(volume) OVER a * 100) AS BIGINT) + count(*) OVER a) // (2 * count(*) OVER a) / 10000.0 AS adv63,
 (200 * CAST(round(sum(volume) OVER b * 100) AS BIGINT) + count(*) OVER b) // (2 * count(*) OVER b) / 10000.0 AS adv30 FROM bars
WINDOW a AS (PARTITION BY sid ORDER BY date ROWS 62 PRECEDING), b AS (PARTITION BY sid ORDER BY date ROWS 29 PRECEDING)""")
def _(t):
    w = ts.by_row()
    df = ts.rolling_moments(t.bars.select("sid", "date", "volume"), "volume", w, 63, "a")
    df = ts.rolling_moments(df, "volume", w, 30, "b")
    for out, k in (("adv63", "a"), ("adv30", "b")):
        df = df.withColumn("_cents", F.round(F.col(f"{k}_mean") * F.col(f"{k}_n") * 100).cast("long"))
        df = df.withColumn(out, F.expr(f"(200 * _cents + {k}_n) div (2 * {k}_n)") / 10000.0)
    return df


@query("agg_trailing_dividend_yield", "sid:i date:t dy:6", """
WITH d AS (SELECT sid, last_date_prior AS date, sum(value) AS dividend FROM cash_events JOIN securities USING (root) WHERE kind = type GROUP BY ALL),
j AS (SELECT b.sid, b.date, b.close, coalesce(d.dividend, 0) AS dividend FROM bars b LEFT JOIN d USING (sid, date))
SELECT sid, date, sum(dividend) OVER (PARTITION BY sid ORDER BY date RANGE BETWEEN INTERVAL 364 DAYS PRECEDING AND CURRENT ROW) / close AS dy FROM j""")
def _(t):
    pairs = t.securities.select("root", F.col("kind").alias("type"), "sid")
    d = t.cash_events.join(pairs, ["root", "type"]).groupBy("sid", F.col("last_date_prior").alias("date")).agg(F.sum("value").alias("dividend"))
    j = t.bars.join(d, ["sid", "date"], "left").withColumn("day", F.unix_date("date"))
    w = Window.partitionBy("sid").orderBy("day").rangeBetween(-364, 0)
    return j.select("sid", "date", (F.sum(F.coalesce("dividend", F.lit(0.0))).over(w) / F.col("close")).alias("dy"))


REGIME_SQL = """
WITH r AS (SELECT date, sno, close / lag(close) OVER (ORDER BY sno) - 1 AS r FROM index_close),
v AS (SELECT *, CASE WHEN sno > 21 THEN stddev_samp(r) OVER (ORDER BY sno ROWS 20 PRECEDING) * sqrt(252) END AS vol, count(r) OVER (ORDER BY sno) AS n FROM r),
m AS (SELECT *, quantile_cont(vol, 0.5) OVER (ORDER BY sno) AS med FROM v),
reg AS (SELECT *, CASE WHEN n < 100 THEN 'mean_rev' WHEN med <= 0 THEN 'mean_rev' WHEN vol > 1.5 * med THEN 'bear' WHEN vol < med THEN 'risk_on' ELSE 'mean_rev' END AS regime FROM m)
"""


def index_regime(t) -> DataFrame:
    return R.vol_regime(t.index_close.withColumn("series", F.lit("index")), "series")


@query("win_rolling_vol_expanding_median", "date:t vol:6 med:6 regime:s", REGIME_SQL + "SELECT * FROM reg")
def _(t):
    return index_regime(t)


@query("regime_rules", "date:t regime:s", """
WITH x AS (SELECT date, sno, close, avg(close) OVER (ORDER BY sno ROWS 199 PRECEDING) AS ma, count(*) OVER (ORDER BY sno) AS n FROM index_close),
v AS (SELECT date, CASE WHEN count(*) > 3 THEN avg(px) / 10 END AS vix FROM (SELECT date, qty AS px FROM trades) GROUP BY date),
j AS (SELECT x.*, vix * 6 AS vix FROM x LEFT JOIN v USING (date))
SELECT date, CASE WHEN vix > 25 THEN 'bear' WHEN n >= 200 AND close > ma AND (vix IS NULL OR vix < 18) THEN 'risk_on' ELSE 'mean_rev' END AS regime FROM j""")
def _(t):
    vix = t.trades.groupBy("date").agg(F.when(F.count("*") > 3, F.avg("qty") / 10 * 6).alias("vix"))
    return R.rule_regime(t.index_close.join(vix, "date", "left"))


@query("macro_sentiment", "date:t direction:s sentiment:s", """
WITH s AS (SELECT date, sno, close AS v, close / lag(close) OVER (ORDER BY sno) - 1 AS c FROM index_close),
d AS (SELECT date, sno, cdi / lag(cdi) OVER (ORDER BY sno) - 1 AS c, cdi * 50000 AS vix FROM cdi)
SELECT s.date, CASE WHEN s.c > 0.001 THEN 'up' WHEN s.c < -0.001 THEN 'down' ELSE 'flat' END AS direction,
 CASE WHEN vix > 25 THEN 'risk_off' WHEN s.c < -0.015 AND d.c > 0.005 THEN 'risk_off' WHEN vix < 18 AND s.c > 0.005 THEN 'risk_on' ELSE 'neutral' END AS sentiment
FROM s JOIN d USING (date)""")
def _(t):
    series = (t.index_close.select("date", F.lit("sp500").alias("symbol"), F.col("close").alias("value"))
              .unionByName(t.cdi.select("date", F.lit("dxy").alias("symbol"), F.col("cdi").alias("value")))
              .unionByName(t.cdi.select("date", F.lit("vix").alias("symbol"), (F.col("cdi") * 50000).alias("value"))))
    return R.macro_sentiment(series)


@query("win_drawdown", "sid:i date:t dd:6", """
SELECT sid, date, close / max(close) OVER (PARTITION BY sid ORDER BY date) - 1 AS dd FROM bars""")
def _(t):
    return t.bars.select("sid", "date", ts.drawdown("close", ts.by_row()).alias("dd"))


@query("win_nav_chain", "sid:i date:t nav:5", """
WITH r AS (SELECT sid, date, CASE WHEN trades < 3 THEN tanh(close / lag(close) OVER (PARTITION BY sid ORDER BY date) - 1) / 50 END AS r FROM bars)
SELECT sid, date, 100 * product(1 + coalesce(r, 0)) OVER (PARTITION BY sid ORDER BY date) AS nav FROM r""")
def _(t):
    w = ts.by_row()
    r = t.bars.select("sid", "date", F.when(F.col("trades") < 3, F.tanh(ts.returns("close", w)) / 50).alias("r"))
    return r.select("sid", "date", ts.chain(F.col("r"), w).alias("nav"))


@query("win_last_known_rate", "date:t rate:12", """
SELECT date, last_value(c IGNORE NULLS) OVER (ORDER BY sno) AS rate FROM (SELECT date, sno, CASE WHEN sno % 5 <> 0 THEN cdi END AS c FROM cdi)""")
def _(t):
    w = Window.partitionBy(F.lit(1)).orderBy("sno")
    return (t.cdi.withColumn("c", F.when(F.col("sno") % 5 != 0, F.col("cdi")))
            .select("date", ts.ffill("c", w).alias("rate")))


@query("join_calendar_left", "date:t ret:6 cdi:12", """
WITH i AS (SELECT date, sno, close / lag(close) OVER (ORDER BY sno) - 1 AS ret FROM index_close),
c AS (SELECT date, cdi FROM cdi WHERE sno % 9 < 2),
j AS (SELECT i.*, c.cdi FROM i LEFT JOIN c USING (date)),
f AS (SELECT date, ret, last_value(cdi IGNORE NULLS) OVER (ORDER BY sno ROWS 5 PRECEDING) AS cdi FROM j)
SELECT * FROM f WHERE ret IS NOT NULL""")
def _(t):
    w = Window.partitionBy(F.lit(1)).orderBy("sno")
    index = t.index_close.select("date", "sno", ts.returns("close", w).alias("ret"))
    rates = t.cdi.filter("sno % 9 < 2").select("date", "cdi")
    j = index.join(rates, "date", "left")
    return j.withColumn("cdi", ts.ffill("cdi", w, 5)).filter("ret is not null")


@query("cdi_on_index", "date:t ret:10", """
WITH l AS (SELECT date, sno, product(1 + cdi) OVER (ORDER BY sno) AS level FROM cdi),
k AS (SELECT date, level FROM l WHERE sno % 4 = 1)
SELECT date, coalesce(level / lag(level) OVER (ORDER BY date) - 1, 0) AS ret FROM k""")
def _(t):
    return R.cdi_on_dates(t.cdi.select("date", "cdi"), t.sessions.filter("sno % 4 = 1").select("date"))


@query("win_month_end", "month:t t:t t_prev:t t_next:t", """
WITH p AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM sessions),
m AS (SELECT date_trunc('month', date) AS month, max(date) AS t, arg_max(prev, date) AS t_prev FROM p GROUP BY 1)
SELECT month, t, t_prev, lead(t) OVER (ORDER BY t) AS t_next FROM m""")
def _(t):
    return ts.month_ends(t.sessions)


@query("win_forward_return", "sid:i t:t fwd:6", """
WITH me AS (SELECT t, lead(t) OVER (ORDER BY t) AS n FROM (SELECT max(date) AS t FROM sessions GROUP BY date_trunc('month', date))),
a AS (SELECT me.t, me.n, b.sid, b.close FROM me JOIN bars b ON b.date = me.t WHERE n IS NOT NULL)
SELECT a.sid, a.t, coalesce((SELECT arg_max(b.close, b.date) FROM bars b WHERE b.sid = a.sid AND b.date > a.t AND b.date <= a.n) / a.close - 1, 0) AS fwd FROM a""")
def _(t):
    return R.month_forward_return(t.bars, ts.month_ends(t.sessions))


@query("win_forward_h", "sid:i date:t fwd5:6 fwd60:6", """
WITH x AS (SELECT sid, date, sno, close,
 last_value(close) OVER (PARTITION BY sid ORDER BY sno RANGE BETWEEN CURRENT ROW AND 5 FOLLOWING) AS c5,
 last_value(close) OVER (PARTITION BY sid ORDER BY sno RANGE BETWEEN CURRENT ROW AND 60 FOLLOWING) AS c60 FROM sbars), mx AS (SELECT max(sno) AS m FROM sessions)
SELECT sid, date, CASE WHEN sno + 5 <= m THEN c5 / close - 1 END AS fwd5, CASE WHEN sno + 60 <= m THEN c60 / close - 1 END AS fwd60 FROM x, mx""")
def _(t):
    last = t.sessions.agg(F.max("sno").alias("last_sno"))
    df = t.sbars.join(F.broadcast(last))
    return df.select("sid", "date", R.forward_h("close", 5).alias("fwd5"), R.forward_h("close", 60).alias("fwd60"))


@query("win_leave_one_out_sector", "sid:i sector:i loo:6", """
SELECT sid, sector, (sum(value) OVER w - value) / nullif(count(*) OVER w - 1, 0) AS loo FROM supplier_x WINDOW w AS (PARTITION BY sector)""")
def _(t):
    g = t.supplier_x.groupBy("sector").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    return t.supplier_x.join(g, "sector").select(
        "sid", "sector", ((F.col("s") - F.col("value")) / F.when(F.col("n") > 1, F.col("n") - 1)).alias("loo"))


@query("join_asof_series", "t:t sid:i level:8 matched:t", """
WITH me AS (SELECT max(date) AS t FROM sessions GROUP BY date_trunc('month', date)), s AS (SELECT DISTINCT sid FROM bars)
SELECT t, s.sid, (SELECT arg_max(close, date) FROM bars b WHERE b.sid = s.sid AND date <= t) AS level,
 (SELECT max(date) FROM bars b WHERE b.sid = s.sid AND date <= t) AS matched FROM me, s""")
def _(t):
    months = ts.month_ends(t.sessions).agg(F.collect_list("t").alias("dates"))
    probes = t.bars.select("sid").distinct().join(F.broadcast(months)).select("sid", F.explode("dates").alias("t"))
    return (ts.asof(probes, t.bars.select("sid", "date", "close"), ["sid"], "t", "date", ["close"])
            .withColumnsRenamed({"close": "level", "date_matched": "matched"}))


@query("agg_price_period_return", "sid:i t:t ret:6", """
WITH me AS (SELECT t, lag(t) OVER (ORDER BY t) AS p FROM (SELECT max(date) AS t FROM sessions GROUP BY date_trunc('month', date))), s AS (SELECT DISTINCT sid FROM bars)
SELECT s.sid, me.t, (SELECT arg_max(close, date) FROM bars b WHERE b.sid = s.sid AND date <= me.t) / (SELECT arg_max(close, date) FROM bars b WHERE b.sid = s.sid AND date < me.p) - 1 AS ret
FROM me, s WHERE me.p IS NOT NULL""")
def _(t):
    w = Window.orderBy("t")
    spans = (ts.month_ends(t.sessions).select("t", F.lag("t").over(w).alias("p")).filter("p is not null")
             .agg(F.collect_list(F.struct("t", "p")).alias("spans")))
    probes = t.bars.select("sid").distinct().join(F.broadcast(spans)).select("sid", F.explode("spans").alias("x")).select("sid", "x.*")
    px = t.bars.select("sid", "date", "close")
    base = ts.asof(probes, px, ["sid"], "p", "date", ["close"], strict=True).withColumnRenamed("close", "base").drop("date_matched")
    return (ts.asof(base, px, ["sid"], "t", "date", ["close"])
            .select("sid", "t", (F.col("close") / F.col("base") - 1).alias("ret")))


@query("agg_period_return", "month:t ret:8", """
SELECT date_trunc('month', date) AS month, product(1 + cdi) - 1 AS ret FROM cdi GROUP BY 1""")
def _(t):
    return t.cdi.groupBy(F.trunc("date", "month").alias("month")).agg((F.product(1 + F.col("cdi")) - 1).alias("ret"))


@query("fn_annualize", "month:t annual:6", """
SELECT date_trunc('month', date) AS month, pow(1 + arg_max(cdi, date), 252) - 1 AS annual FROM cdi GROUP BY 1""")
def _(t):
    from factorspark.functions.scalars import annualize

    return (t.cdi.groupBy(F.trunc("date", "month").alias("month")).agg(F.max_by("cdi", "date").alias("last"))
            .select("month", annualize(F.col("last")).alias("annual")))


@query("benchmark_alignment", "t:t index_ret:6 etf_ret:6 gap_pp:4 consistent:b", """
WITH me AS (SELECT max(date) AS t, max(sno) AS sno FROM sessions GROUP BY date_trunc('month', date)),
x AS (SELECT me.t, i.close AS idx, lag(i.close) OVER (ORDER BY me.t) AS idx0 FROM me JOIN index_close i ON i.date = me.t),
e AS (SELECT date, max(close) AS etf FROM bars GROUP BY date),
y AS (SELECT me.t, e.etf, lag(e.etf) OVER (ORDER BY me.t) AS etf0 FROM me JOIN e ON e.date = me.t)
SELECT t, idx / idx0 - 1 AS index_ret, etf / etf0 - 1 AS etf_ret, (idx / idx0 - etf / etf0) * 100 AS gap_pp, abs(idx / idx0 - etf / etf0) <= 0.015 AS consistent
FROM x JOIN y USING (t) WHERE idx0 IS NOT NULL""")
def _(t):
    etf = t.bars.groupBy("date").agg(F.max("close").alias("etf"))
    return R.etf_check(ts.month_ends(t.sessions).select("t"), t.index_close.select("date", "close"), etf)
