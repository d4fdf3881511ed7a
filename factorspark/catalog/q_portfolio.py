"""Portfolio, allocation and order queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from factorspark.catalog import q_selection as QS
from factorspark.catalog.q_scalars import sql_cdf, sql_ppf
from factorspark.catalog.q_windows import REGIME_SQL, index_regime
from factorspark.catalog.registry import query
from factorspark.operators import evaluate as E
from factorspark.operators import portfolio as W
from factorspark.operators import selection as L
from factorspark.operators import stats as S
from factorspark.operators import timeseries as ts
from factorspark.plans import rules as U
from factorspark.operators import volatility as V

NORM_SQL = """
WITH b AS (SELECT rec, rec_date, sid, CASE WHEN sid % 13 <> 0 THEN value END AS value FROM baskets),
nw AS (SELECT *, sum(value) OVER w AS s, count(*) OVER w AS n, count(value) OVER w AS k FROM b WINDOW w AS (PARTITION BY rec, rec_date))
"""


def gappy_baskets(t):
    return t.baskets.withColumn("value", F.when(F.col("sid") % 13 != 0, F.col("value")))


@query("normalize_weights", "rec:i rec_date:t sid:i w:8 w2:8", NORM_SQL + """
SELECT rec, rec_date, sid, CASE WHEN coalesce(s > 0 AND k = n, false) THEN value / s ELSE 1 / n END AS w, CASE WHEN coalesce(s > 0, false) THEN coalesce(value, 0) / s ELSE 1 / n END AS w2 FROM nw""")
def _(t):
    b = gappy_baskets(t)
    one = W.normalize_weights(b, ["rec", "rec_date"], "value").select("rec", "rec_date", "sid", "w")
    two = W.normalize_weights(b, ["rec", "rec_date"], "value", "sum").select("rec", "rec_date", "sid", F.col("w").alias("w2"))
    return one.join(two, ["rec", "rec_date", "sid"])


def basket_weights(t):
    return W.normalize_weights(t.baskets, ["rec", "rec_date"], "value").select("rec", "rec_date", "sid", "w")


BW = "bw AS (SELECT rec, rec_date, sid, value / sum(value) OVER (PARTITION BY rec, rec_date) AS w FROM baskets)"


@query("transaction_cost", "rec:i rec_date:t cost:7 turnover:6", f"""
WITH {BW}, d AS (SELECT rec, rec_date, lead(rec_date) OVER (PARTITION BY rec ORDER BY rec_date) AS nx FROM (SELECT DISTINCT rec, rec_date FROM bw)),
o AS (SELECT bw.rec, d.nx AS rec_date, sid, w FROM bw JOIN d USING (rec, rec_date) WHERE nx IS NOT NULL),
j AS (SELECT coalesce(a.rec, o.rec) AS rec, coalesce(a.rec_date, o.rec_date) AS rec_date, coalesce(a.sid, o.sid) AS sid, abs(coalesce(a.w, 0) - coalesce(o.w, 0)) AS d FROM bw a FULL JOIN o ON a.rec = o.rec AND a.rec_date = o.rec_date AND a.sid = o.sid)
SELECT rec, rec_date, sum(d * CASE WHEN adv IS NULL OR adv <= 0 THEN 0.0013 ELSE 0.0013 * greatest(1, least(5, sqrt(50000000 / greatest(adv, 1)))) END) AS cost, sum(d) / 2 AS turnover FROM j LEFT JOIN fundamentals USING (sid) GROUP BY ALL""")
def _(t):
    from factorspark.functions.scalars import friction
    b = basket_weights(t)
    nxt = b.select("rec", "rec_date").distinct().withColumn("_n", F.lead("rec_date").over(Window.partitionBy("rec").orderBy("rec_date")))
    old = b.join(nxt, ["rec", "rec_date"]).filter("_n is not null").select("rec", F.col("_n").alias("rec_date"), "sid", "w")
    both = b.select("rec", "rec_date", "sid").unionByName(old.select("rec", "rec_date", "sid")).distinct()
    cost = both.join(t.fundamentals.select("sid", friction(F.col("adv")).alias("friction")), "sid")
    return W.transaction_cost(b, old, ["rec", "rec_date"], cost)


IV_SQL = QS.SCORED_SQL.replace("WITH sc", "WITH RECURSIVE sc") + """,
tp AS (SELECT t, sid, CASE WHEN sid % 5 <> 0 THEN (sid * 73 % 89) / 200 + 0.02::DOUBLE END AS vol FROM sc QUALIFY row_number() OVER (PARTITION BY t ORDER BY score DESC, sid) <= 5),
iv AS (SELECT t, sid, coalesce(CASE WHEN vol > 0 THEN 1 / greatest(vol, 0.1) END, avg(CASE WHEN vol > 0 THEN 1 / greatest(vol, 0.1) END) OVER (PARTITION BY t)) AS x, count(*) OVER (PARTITION BY t) AS n FROM tp),
w0 AS (SELECT t, sid, n, x / sum(x) OVER (PARTITION BY t) AS w, 0 AS it, false AS done FROM iv),
it AS (SELECT * FROM w0 UNION ALL
  SELECT t, sid, n, CASE WHEN done THEN w ELSE w2 END, it + 1, done OR bool_and(l >= 0.3 OR (w2 >= 0.05 - 1e-9 AND w2 <= 0.3 + 1e-9)) OVER (PARTITION BY t) FROM (
    SELECT *, CASE WHEN l >= 0.3 THEN 0.3 ELSE l / sum(l) FILTER (l < 0.3) OVER (PARTITION BY t) * (1 - 0.3 * count(*) FILTER (l >= 0.3) OVER (PARTITION BY t)) END AS w2
    FROM (SELECT *, greatest(w, 0.05) AS l FROM it WHERE it < 50)))
SELECT t, sid, round(w / sum(w) OVER (PARTITION BY t), 6) AS w FROM it WHERE it = 50"""


@query("inverse_vol_weights", "t:t sid:i w:6", IV_SQL)
def _(t):
    top = L.top_n(QS.monthly_scores(t), ["t"], "score", 5)
    vol = F.when(F.col("sid") % 5 != 0, (F.col("sid") * 73 % 89) / 200 + 0.02)
    return W.inverse_vol_weights(top.withColumn("vol", vol), ["t"], "vol")


# four sleeves on the session calendar; the last one starts trading at session 301
SLEEVES_SQL = """
sx AS (SELECT date, sno - 1 AS i, tanh(close / lag(close) OVER (ORDER BY sno) - 1) / 20 AS eq, close FROM index_close),
sq AS (SELECT date, tanh(q / lag(q) OVER (ORDER BY date) - 1) / 30 AS gl FROM (SELECT date, avg(qty) AS q FROM trades GROUP BY date)),
sd AS (SELECT date, avg(disc) * 0.02 - 0.0005 AS inf FROM trades GROUP BY date),
sl AS (SELECT sx.i, sx.date, sx.eq, sq.gl, CASE WHEN sx.i > 300 THEN sd.inf END AS inf, cdi.cdi FROM sx JOIN sq USING (date) JOIN sd USING (date) JOIN cdi USING (date))"""


def sleeve_returns(t):
    w = Window.partitionBy(F.lit(1)).orderBy("sno")
    eq = t.index_close.select("date", "sno", (F.tanh(ts.returns("close", w)) / 20).alias("equities_br"))
    q = t.trades.groupBy("date").agg(F.avg("qty").alias("q"), (F.avg("disc") * 0.02 - 0.0005).alias("inf"))
    wd = Window.partitionBy(F.lit(1)).orderBy("date")
    q = q.select("date", (F.tanh(F.col("q") / F.lag("q").over(wd) - 1) / 30).alias("global_usd"), "inf")
    j = eq.join(q, "date").join(t.cdi.select("date", "cdi"), "date").withColumn("i", F.col("sno") - 1)
    j = j.withColumn("inflation", F.when(F.col("i") > 300, F.col("inf")))
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("sleeve"), F.col(s).alias("ret")) for s in W.SLEEVES]))
    return j.select("i", "date", rows.alias("r")).select("i", "date", "r.*")


def targets(t, k=21):
    """Static and dynamic targets at every rebalance; a sleeve not trading yet goes to cash."""
    reg = index_regime(t).select("date", "regime").join(W.tsmom_excess(t.index_close, t.cdi.select("date", "cdi")), "date").withColumn("i", F.col("sno") - 1)
    last = t.sessions.agg((F.max("sno") - 1).alias("last"))
    reg = reg.filter(F.col("i") % k == 0).join(F.broadcast(last)).filter("i < last")
    dyn = W.mix_to_rows(reg.select("i", "regime", "tsmom"), W.dynamic_mix(F.col("regime"), None, F.col("tsmom")))
    sta = W.mix_to_rows(reg.select("i"), {s: F.lit(w) for s, w in W.STATIC_MIX.items()})
    both = dyn.select(F.lit("dynamic").alias("mix"), "i", "sleeve", "w").unionByName(sta.select(F.lit("static").alias("mix"), "i", "sleeve", "w"))
    live = F.when((F.col("sleeve") == "inflation") & (F.col("i") < 300), "cdi").otherwise(F.col("sleeve"))
    return both.groupBy("mix", "i", live.alias("sleeve")).agg(F.sum("w").alias("w"))


MIX_SQL = REGIME_SQL.replace("WITH r AS", "WITH RECURSIVE r AS") + "," + SLEEVES_SQL + """,
lv AS (SELECT i.date, i.sno, i.close, product(1 + cdi) OVER (ORDER BY i.sno) AS c FROM index_close i JOIN cdi USING (date)),
tm AS (SELECT *, CASE WHEN sno >= 51 THEN lag(close, 21) OVER w / CASE WHEN sno > 252 THEN lag(close, 251) OVER w ELSE nth_value(close, 2) OVER w END - 1
   - (c / CASE WHEN sno > 252 THEN lag(c, 231) OVER w ELSE nth_value(c, 22) OVER w END - 1) END AS tsmom FROM lv WINDOW w AS (ORDER BY sno)),
tg0 AS (SELECT reg.sno - 1 AS i, regime, tsmom FROM reg JOIN tm USING (date)),
tg1 AS (SELECT i, regime, tsmom, CASE regime WHEN 'risk_on' THEN 0.6 WHEN 'bear' THEN 0.2 ELSE 0.4 END AS be, CASE regime WHEN 'risk_on' THEN 0.15 WHEN 'bear' THEN 0.5 ELSE 0.3 END AS bc,
  CASE regime WHEN 'risk_on' THEN 0.10 ELSE 0.15 END AS bi, CASE WHEN tsmom > 0 THEN 0.1 WHEN tsmom <= 0 THEN -0.1 ELSE 0 END AS tilt FROM tg0),
tg2 AS (SELECT *, greatest(0.1, least(0.7, be + tilt)) AS e FROM tg1), tg3 AS (SELECT *, greatest(bc - (e - be), 0) AS c FROM tg2),
tg AS (SELECT 'dynamic' AS mix, i, e / (e + c + 0.15 + bi) AS we, c / (e + c + 0.15 + bi) AS wc, 0.15 / (e + c + 0.15 + bi) AS wg, bi / (e + c + 0.15 + bi) AS wi FROM tg3
  UNION ALL SELECT 'static', i, 0.4, 0.3, 0.15, 0.15 FROM tg3),
ta AS (SELECT mix, i, CAST(we AS DOUBLE) AS we, CAST(CASE WHEN i < 300 THEN wc + wi ELSE wc END AS DOUBLE) AS wc, CAST(wg AS DOUBLE) AS wg, CAST(CASE WHEN i < 300 THEN 0 ELSE wi END AS DOUBLE) AS wi FROM tg)
"""
SIM_SQL = MIX_SQL + """,
sim AS (
  SELECT mix, CAST(0 AS BIGINT) AS i, CAST(100 AS DOUBLE) AS nav, we * 99.9 AS e, wc * 99.9 AS c, wg * 99.9 AS g, wi * 99.9 AS f FROM ta WHERE i = 0
  UNION ALL
  SELECT mix, i, nav, CASE WHEN rb THEN we * nn ELSE e END, CASE WHEN rb THEN wc * nn ELSE c END, CASE WHEN rb THEN wg * nn ELSE g END, CASE WHEN rb THEN wi * nn ELSE f END FROM (
    SELECT *, nav * (1 - (abs(we - e / nav) + abs(wc - c / nav) + abs(wg - g / nav) + abs(wi - f / nav)) * 0.001) AS nn FROM (
      SELECT s.mix, sl.i, sl.i % 21 = 0 AS rb, s.e * (1 + coalesce(sl.eq, 0)) AS e, s.c * (1 + sl.cdi) AS c, s.g * (1 + coalesce(sl.gl, 0)) AS g, s.f * (1 + coalesce(sl.inf, 0)) AS f,
        s.e * (1 + coalesce(sl.eq, 0)) + s.c * (1 + sl.cdi) + s.g * (1 + coalesce(sl.gl, 0)) + s.f * (1 + coalesce(sl.inf, 0)) AS nav, ta.we, ta.wc, ta.wg, ta.wi
      FROM sim s JOIN sl ON sl.i = s.i + 1 JOIN ta ON ta.mix = s.mix AND ta.i = sl.i)))
"""


@query("allocation", "mix:s i:i sleeve:s w:6", MIX_SQL + """
SELECT mix, i, sleeve, w FROM (SELECT mix, i, unnest(['equities_br', 'cdi', 'global_usd', 'inflation']) AS sleeve, unnest([we, wc, wg, wi]) AS w FROM ta)
WHERE i % 21 = 0 AND i < (SELECT max(sno) - 1 FROM sessions) AND NOT (sleeve = 'inflation' AND i < 300)""")
def _(t):
    return targets(t)


@query("allocation_overlay", "date:t equities:10 cash:10", """
WITH f AS (SELECT date, sno, cdi * 1000 AS gross, (sno % 12) / 100 AS erp FROM cdi),
g AS (SELECT *, CAST(greatest(0, least(1, gross / 0.6)) AS DOUBLE) AS x, CAST(greatest(0.1, least(0.7, 0.4 + CASE WHEN erp < 0.02 THEN -0.1 WHEN erp > 0.08 THEN 0.1 ELSE 0 END)) AS DOUBLE) AS e FROM f),
h AS (SELECT date, e * x AS equities, greatest(0.3 - (e - 0.4), 0) + e * (1 - x) AS cash FROM g)
SELECT date, equities / (equities + cash + 0.15 + 0.15) AS equities, cash / (equities + cash + 0.15 + 0.15) AS cash FROM h""")
def _(t):
    df = t.cdi.select("date", (F.col("cdi") * 1000 / 0.6).alias("gross"), ((F.col("sno") % 12) / 100).alias("erp"))
    mix = W.dynamic_mix(F.lit("mean_rev"), F.col("erp"), F.lit(None).cast("double"), F.col("gross"))
    return df.select("date", mix["equities_br"].alias("equities"), mix["cdi"].alias("cash"))


def navs(t):
    r = sleeve_returns(t)
    mixes = F.explode(F.array(F.lit("dynamic"), F.lit("static")))
    return W.drift_nav(r.withColumn("mix", mixes), targets(t), ["mix"])


@query("drift_nav", "mix:s i:i nav:3", SIM_SQL + "SELECT mix, i, nav FROM sim")
def _(t):
    return navs(t)


SHP = "((sr - {b}) * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr))"


def _ems(k):
    import math
    return f"(sqrt(1 / (n - 1)) * ({1 - S.EULER_GAMMA!r} * {sql_ppf(f'CAST({1 - 1 / k!r} AS DOUBLE)')} + {S.EULER_GAMMA!r} * {sql_ppf(f'CAST({1 - 1 / (k * math.e)!r} AS DOUBLE)')}))"


@query("nav_metrics", "mix:s n_days:i ann_return:5 ann_vol:5 sharpe:4 max_drawdown:5 psr:5 dsr_4:5 dsr_20:5", SIM_SQL + f""",
rt AS (SELECT sim.*, nav / lag(nav) OVER (PARTITION BY mix ORDER BY sim.i) - 1 AS r, nav / max(nav) OVER (PARTITION BY mix ORDER BY sim.i) - 1 AS dd, sl.cdi FROM sim JOIN sl ON sl.i = sim.i),
mm AS (SELECT mix, count(r) AS n_days, count(r) AS n, pow(arg_max(nav, i) / arg_min(nav, i), 252 / count(r)) - 1 AS ann_return, stddev_samp(r) * sqrt(252) AS ann_vol, avg(r - cdi) / stddev_samp(r - cdi) AS sr,
  min(dd) AS max_drawdown, skewness(r - cdi) AS sk, kurtosis(r - cdi) + 3 AS ku FROM rt GROUP BY mix)
SELECT mix, n_days, ann_return, ann_vol, sr * sqrt(252) AS sharpe, max_drawdown, {sql_cdf(SHP.format(b=0))} AS psr, {sql_cdf(SHP.format(b=_ems(4)))} AS dsr_4, {sql_cdf(SHP.format(b=_ems(20)))} AS dsr_20 FROM mm""")
def _(t):
    rate = t.cdi.select(F.col("cdi").alias("rate"), "date")
    return S.nav_metrics(navs(t).join(rate, "date"), ["mix"], "i")


SENS_SQL = "WITH RECURSIVE " + SLEEVES_SQL.strip() + """,
of AS (SELECT CAST(unnest(range(21)) AS BIGINT) AS o),
sim AS (
  SELECT o, o AS i, CAST(100 AS DOUBLE) AS nav, CAST(0.4 * 99.9 AS DOUBLE) AS e, CAST(CASE WHEN o < 300 THEN 0.45 ELSE 0.3 END * 99.9 AS DOUBLE) AS c, CAST(0.15 * 99.9 AS DOUBLE) AS g, CAST(0 AS DOUBLE) AS f FROM of
  UNION ALL
  SELECT o, i, nav, CASE WHEN rb THEN 0.4 * nn ELSE e END, CASE WHEN rb THEN wc * nn ELSE c END, CASE WHEN rb THEN 0.15 * nn ELSE g END, CASE WHEN rb THEN wi * nn ELSE f END FROM (
    SELECT *, nav * (1 - (abs(0.4 - e / nav) + abs(wc - c / nav) + abs(0.15 - g / nav) + abs(wi - f / nav)) * 0.001) AS nn FROM (
      SELECT s.o, sl.i, (sl.i - s.o) % 21 = 0 AS rb, s.e * (1 + coalesce(sl.eq, 0)) AS e, s.c * (1 + sl.cdi) AS c, s.g * (1 + coalesce(sl.gl, 0)) AS g, s.f * (1 + coalesce(sl.inf, 0)) AS f,
        s.e * (1 + coalesce(sl.eq, 0)) + s.c * (1 + sl.cdi) + s.g * (1 + coalesce(sl.gl, 0)) + s.f * (1 + coalesce(sl.inf, 0)) AS nav, CASE WHEN sl.i < 300 THEN 0.45 ELSE 0.3 END AS wc, CASE WHEN sl.i < 300 THEN 0 ELSE 0.15 END AS wi
      FROM sim s JOIN sl ON sl.i = s.i + 1))),
rt AS (SELECT o, sim.i, nav / lag(nav) OVER (PARTITION BY o ORDER BY sim.i) - 1 - cdi AS e FROM sim JOIN sl ON sl.i = sim.i),
sr AS (SELECT o, avg(e) / stddev_samp(e) * sqrt(252) AS s FROM rt GROUP BY o)
SELECT min(s) AS lo, median(s) AS med, max(s) AS hi, count(*) AS n_offsets FROM sr"""


@query("start_sensitivity", "lo:4 med:4 hi:4 n_offsets:i", SENS_SQL)
def _(t):
    r = sleeve_returns(t).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(20)))).filter("i >= o").withColumn("abs_i", F.col("i")).withColumn("i", F.col("i") - F.col("o"))
    days = r.select("o", "i", "abs_i").distinct().filter("i % 21 = 0")
    tg = W.mix_to_rows(days, {s: F.lit(w) for s, w in W.STATIC_MIX.items()})
    live = F.when((F.col("sleeve") == "inflation") & (F.col("abs_i") < 300), "cdi").otherwise(F.col("sleeve"))
    tg = tg.groupBy("o", "i", live.alias("sleeve")).agg(F.sum("w").alias("w"))
    nav = W.drift_nav(r, tg, ["o"]).join(t.cdi.select("date", F.col("cdi").alias("rate")), "date")
    m = S.nav_metrics(nav, ["o"], "i", trials=())
    return m.agg(F.min("sharpe").alias("lo"), F.percentile("sharpe", 0.5).alias("med"), F.max("sharpe").alias("hi"), F.count("*").alias("n_offsets"))


# daily returns of one portfolio per sector, weights by account balance
DAILY_SQL = """
WITH r AS (SELECT sid, date, tanh(close / lag(close) OVER (PARTITION BY sid ORDER BY date) - 1) / 20 AS r FROM bars),
w AS (SELECT sid, sector, acctbal + 2000 AS v FROM securities),
dr AS (SELECT w.sector, r.date, sum(v * r) / sum(v) AS ret, avg(r) AS ew FROM r JOIN w USING (sid) WHERE r IS NOT NULL GROUP BY ALL)
"""


def sector_daily(t):
    r = t.bars.select("sid", "date", (F.tanh(ts.returns("close", ts.by_row())) / 20).alias("r")).filter("r is not null")
    w = t.securities.select("sid", "sector", (F.col("acctbal") + 2000).alias("v"))
    return r.join(w, "sid").groupBy("sector", "date").agg((F.sum(F.col("v") * F.col("r")) / F.sum("v")).alias("ret"), F.avg("r").alias("ew"))


@query("portfolio_daily_returns", "sector:s date:t ret:7 ew:7", DAILY_SQL + "SELECT * FROM dr")
def _(t):
    return sector_daily(t)


@query("agg_var_cvar", "sector:s n_obs:i var_95:6 cvar_95:6 ann_vol:5 sharpe_naive:4 hhi:6 effective_n:4", DAILY_SQL + """,
q AS (SELECT sector, quantile_cont(ret, 0.05) AS v FROM dr GROUP BY sector), h AS (SELECT sector, sum(pow(v / s, 2)) AS hhi FROM (SELECT *, sum(v) OVER (PARTITION BY sector) AS s FROM w) GROUP BY sector)
SELECT sector, count(*) AS n_obs, max(q.v) AS var_95, avg(CASE WHEN ret <= q.v THEN ret END) AS cvar_95, stddev_samp(ret) * sqrt(252) AS ann_vol, avg(ret) * 252 / (stddev_samp(ret) * sqrt(252)) AS sharpe_naive, max(hhi) AS hhi, 1 / max(hhi) AS effective_n
FROM dr JOIN q USING (sector) JOIN h USING (sector) GROUP BY sector""")
def _(t):
    w = W.normalize_weights(t.securities.select("sector", "sid", (F.col("acctbal") + 2000).alias("v")), ["sector"], "v", "sum")
    return E.tail_risk(sector_daily(t), ["sector"]).join(E.concentration(w, ["sector"]), "sector")


@query("vol_target", "sector:s vol:5 gross:5", DAILY_SQL.replace("WITH r", "WITH RECURSIVE r") + """,
x AS (SELECT sector, ret, row_number() OVER (PARTITION BY sector ORDER BY date DESC) AS j FROM dr QUALIFY j <= 251), y AS (SELECT sector, ret, row_number() OVER (PARTITION BY sector ORDER BY j DESC) AS i FROM x),
e AS (SELECT sector, i, ret * ret AS v FROM y WHERE i = 1 UNION ALL SELECT e.sector, y.i, 0.94 * e.v + 0.06 * y.ret * y.ret FROM e JOIN y ON y.sector = e.sector AND y.i = e.i + 1)
SELECT sector, sqrt(252 * arg_max(v, i)) AS vol, greatest(0.5, least(1.0, 0.14 / sqrt(252 * arg_max(v, i)))) AS gross FROM e GROUP BY sector""")
def _(t):
    v = V.ewma_vol(sector_daily(t), ["sector"])
    return v.select("sector", F.col("vol_ewma").alias("vol"), V.gross_exposure(F.col("vol_ewma")).alias("gross"))


ORDER_SQL = f"""
WITH {BW}, rc AS (SELECT rec, max(rec_date) AS rec_date FROM bw GROUP BY rec), pk AS (SELECT bw.rec, sid, w FROM bw JOIN rc USING (rec, rec_date)),
ac AS (SELECT c_custkey AS account, c_custkey AS rec, abs(c_acctbal) * 50 + 5000 AS capital FROM customer WHERE c_custkey IN (SELECT rec FROM pk)),
px AS (SELECT sid, CASE WHEN sid % 9 <> 0 THEN arg_max(close, date) END AS price FROM bars GROUP BY sid),
o AS (SELECT ac.account, ac.rec, capital, round(capital * 0.4, 2) AS equity, sid, round(capital * 0.4, 2) * w AS target, price, CASE WHEN price > 0 THEN floor(round(capital * 0.4, 2) * w / price) END AS qty
  FROM ac JOIN pk USING (rec) LEFT JOIN px USING (sid)),
os AS (SELECT *, CASE WHEN price > 0 THEN round(qty * price, 2) END AS value, target - coalesce(qty * price, 0) AS unused FROM o),
"""


def orders(t):
    b = basket_weights(t)
    last = b.groupBy("rec").agg(F.max("rec_date").alias("rec_date"))
    pk = b.join(last, ["rec", "rec_date"]).select("rec", "sid", "w")
    acc = t.raw("customer").select(F.col("c_custkey").alias("account"), F.col("c_custkey").alias("rec"), (F.abs("c_acctbal") * 50 + 5000).alias("capital"))
    px = t.bars.groupBy("sid").agg(F.max_by("close", "date").alias("last")).select("sid", F.when(F.col("sid") % 9 != 0, F.col("last")).alias("price"))
    sl = pk.select("rec").distinct().withColumn("equity_w", F.lit(0.4)).withColumn("cdi_w", F.lit(0.3))
    prices = pk.select("rec", "sid").join(px, "sid")
    prev = b.join(last, ["rec"]).filter(b.rec_date < last.rec_date).groupBy("rec").agg(F.max(b.rec_date).alias("rec_date"))
    return W.order_sheet(acc, sl, pk, prices), b.join(prev, ["rec", "rec_date"]).select("rec", "sid")


@query("order_sheet", "account:i sid:i qty:i unused:4", ORDER_SQL + "z AS (SELECT 1) SELECT * FROM os")
def _(t):
    return orders(t)[0]


@query("order_summary", "account:i residual:7 exits:i entries:i sales:5 tax:s", ORDER_SQL + """
pd AS (SELECT bw.rec, max(bw.rec_date) AS rec_date FROM bw JOIN rc ON rc.rec = bw.rec AND bw.rec_date < rc.rec_date GROUP BY bw.rec), pv AS (SELECT rec, sid FROM bw JOIN pd USING (rec, rec_date)),
g AS (SELECT account, rec, max(equity) AS equity, sum(unused) AS residual, count(*) AS n_now FROM os GROUP BY ALL), h AS (SELECT rec, count(*) AS n_prev FROM pv GROUP BY rec),
k AS (SELECT os.account, count(*) AS n_kept FROM os JOIN pv ON pv.rec = os.rec AND pv.sid = os.sid GROUP BY 1),
s AS (SELECT g.account, residual, coalesce(n_prev, 0) - coalesce(n_kept, 0) AS exits, CASE WHEN n_prev > 0 THEN n_now - coalesce(n_kept, 0) ELSE 0 END AS entries, CASE WHEN n_prev > 0 THEN equity / n_prev * (n_prev - coalesce(n_kept, 0)) ELSE 0 END AS sales
  FROM g LEFT JOIN h USING (rec) LEFT JOIN k USING (account))
SELECT *, CASE WHEN sales <= 0 THEN 'none' WHEN sales < 20000 THEN 'exempt' ELSE 'taxed' END AS tax FROM s""")
def _(t):
    o, prev = orders(t)
    return W.order_summary(o, prev)


@query("target_fn", "i:i nav:4", "WITH RECURSIVE " + SLEEVES_SQL.strip() + """,
sim AS (SELECT CAST(0 AS BIGINT) AS i, CAST(100 AS DOUBLE) AS nav, CAST(49.95 AS DOUBLE) AS e, CAST(49.95 AS DOUBLE) AS c UNION ALL
  SELECT i, nav, CASE WHEN rb THEN 0.5 * nav * (1 - (abs(0.5 - e / nav) + abs(0.5 - c / nav)) * 0.001) ELSE e END, CASE WHEN rb THEN 0.5 * nav * (1 - (abs(0.5 - e / nav) + abs(0.5 - c / nav)) * 0.001) ELSE c END FROM (
    SELECT sl.i, sl.i % 63 = 0 AS rb, e * (1 + coalesce(sl.eq, 0)) + c * (1 + sl.cdi) AS nav, e * (1 + coalesce(sl.eq, 0)) AS e, c * (1 + sl.cdi) AS c FROM sim s JOIN sl ON sl.i = s.i + 1))
SELECT i, nav FROM sim""")
def _(t):
    # a target rule is any frame of (variant, i, sleeve, w): here equal parts of shares and cash each quarter
    days = t.sessions.select((F.col("sno") - 1).alias("i")).filter("i % 63 = 0").withColumn("mix", F.lit("half"))
    rule = W.mix_to_rows(days, {"equities_br": F.lit(0.5), "cdi": F.lit(0.5)})
    return W.drift_nav(sleeve_returns(t).withColumn("mix", F.lit("half")), rule, ["mix"], k=63)


REGIME_RULE = """
WITH w AS (SELECT i, CASE regime WHEN 'risk_on' THEN bold WHEN 'bear' THEN 1 - bold ELSE 0.5D END AS e FROM rule_days)
SELECT i, 'equities_br', e FROM w UNION ALL SELECT i, 'cdi', 1 - e FROM w"""
PARTS_RULE = "SELECT i, s.sleeve, s.w FROM rule_days LATERAL VIEW explode(array(named_struct('sleeve', 'cdi', 'w', cash), named_struct('sleeve', 'equities_br', 'w', 1 - cash))) x AS s"


@query("target_rule_functions", "rule:s i:i nav:4", MIX_SQL + """,
tr AS (SELECT 'parts' AS rule, i, 0.6::DOUBLE AS we FROM tg0 UNION ALL SELECT 'regime', i, CASE regime WHEN 'risk_on' THEN 0.8::DOUBLE WHEN 'bear' THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END FROM tg0),
sim2 AS (
  SELECT rule, CAST(0 AS BIGINT) AS i, CAST(100 AS DOUBLE) AS nav, we * 99.9 AS e, (1 - we) * 99.9 AS c FROM tr WHERE i = 0
  UNION ALL
  SELECT rule, i, nav, CASE WHEN rb THEN we * nn ELSE e END, CASE WHEN rb THEN (1 - we) * nn ELSE c END FROM (
    SELECT *, nav * (1 - (abs(we - e / nav) + abs(1 - we - c / nav)) * 0.001) AS nn FROM (
      SELECT s.rule, sl.i, sl.i % 21 = 0 AS rb, s.e * (1 + coalesce(sl.eq, 0)) AS e, s.c * (1 + sl.cdi) AS c, s.e * (1 + coalesce(sl.eq, 0)) + s.c * (1 + sl.cdi) AS nav, tr.we
      FROM sim2 s JOIN sl ON sl.i = s.i + 1 JOIN tr ON tr.rule = s.rule AND tr.i = sl.i)))
SELECT rule, i, nav FROM sim2""")
def _(t):
    days = index_regime(t).select((F.col("sno") - 1).alias("i"), "date", "regime").filter("i % 21 = 0")
    regime = U.target_rule(days, "regime_target", REGIME_RULE, "bold DOUBLE")
    parts = U.target_rule(days, "parts_target", PARTS_RULE, "cash DOUBLE DEFAULT 0.5")
    both = days.transform(regime, 0.8).withColumn("rule", F.lit("regime")).unionByName(days.transform(parts, 0.4).withColumn("rule", F.lit("parts")))
    rets = sleeve_returns(t).withColumn("rule", F.explode(F.array(F.lit("regime"), F.lit("parts"))))
    return W.drift_nav(rets, both, ["rule"])
