"""Projection, filter and predicate queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from factorspark.catalog.registry import query
from factorspark.functions import calendar as C
from factorspark.operators import live as L

FIN = "sector = 'ASIA'"

CLEAN_SQL = """
WITH f AS (SELECT *, 5 + (sid * 31 % 400) / 10 AS price FROM fundamentals),
a AS (SELECT *, CASE WHEN abs(roe) > 5 THEN roe / 100 ELSE roe END AS r1, CASE WHEN abs(roic) > 5 THEN roic / 100 ELSE roic END AS r2,
      CASE WHEN dividend_yield > 1 THEN dividend_yield / 100 ELSE dividend_yield END AS d1 FROM f),
clean AS (SELECT * EXCLUDE (r1, r2, d1) REPLACE (CASE WHEN pl > 0 THEN pl END AS pl, CASE WHEN r1 >= -1 THEN r1 END AS roe, CASE WHEN r2 >= -1 THEN r2 END AS roic,
   CASE WHEN d1 <= 0.2 THEN d1 END AS dividend_yield, CASE WHEN adv < 1000000 AND adv > 0 AND price > 0 THEN adv * price ELSE adv END AS adv) FROM a),
derived AS (SELECT * REPLACE (CASE WHEN roe BETWEEN -1 AND 1.5 THEN roe END AS roe, CASE WHEN roic BETWEEN -1 AND 1.5 THEN roic END AS roic,
   CASE WHEN abs(debt_ebitda) <= 50 THEN debt_ebitda END AS debt_ebitda),
   CASE WHEN pl > 0 THEN 1 / pl END AS earnings_yield, CASE WHEN market_cap > 0 THEN log10(market_cap) END AS log_market_cap FROM clean)
"""


def clean(t):
    return L.cast_and_clean(t.fundamentals.withColumn("price", 5 + (F.col("sid") * 31 % 400) / 10))


def derived(t):
    return L.derive_metrics(clean(t))


@query("cast_and_clean", "sid:i pl:6 roe:6 roic:6 dividend_yield:6 adv:4", CLEAN_SQL + "SELECT * FROM clean")
def _(t):
    return clean(t)


@query("derive_metrics", "sid:i earnings_yield:8 log_market_cap:6 roe:6 roic:6 debt_ebitda:6", CLEAN_SQL + "SELECT * FROM derived")
def _(t):
    return derived(t)


MERGE_SQL = """
WITH a AS (SELECT sid, CASE WHEN sid % 3 <> 0 THEN pl END AS pl, dividend_yield, CASE WHEN sid % 2 = 0 THEN adv END AS adv FROM fundamentals WHERE sid % 5 <> 0),
b AS (SELECT sid, pl * 2 AS pl, CASE WHEN sid % 4 <> 0 THEN dividend_yield / 2 END AS dividend_yield, adv + 1 AS adv FROM fundamentals WHERE sid % 7 <> 0)
SELECT coalesce(a.sid, b.sid) AS sid, coalesce(a.pl, b.pl) AS pl, coalesce(a.dividend_yield, b.dividend_yield) AS dividend_yield, coalesce(a.adv, b.adv) AS adv,
 CASE WHEN a.sid IS NOT NULL AND b.sid IS NOT NULL THEN 'quote+yearly' WHEN a.sid IS NOT NULL THEN 'quote' ELSE 'yearly' END AS data_source
FROM a FULL JOIN b ON a.sid = b.sid"""


@query("merge_sources", "sid:i pl:6 dividend_yield:6 adv:2 data_source:s", MERGE_SQL)
def _(t):
    f = t.fundamentals.select("sid", "pl", "dividend_yield", "adv")
    a = (f.filter("sid % 5 <> 0").withColumn("pl", F.when(F.col("sid") % 3 != 0, F.col("pl")))
         .withColumn("adv", F.when(F.col("sid") % 2 == 0, F.col("adv"))))
    b = (f.filter("sid % 7 <> 0").withColumn("pl", F.col("pl") * 2).withColumn("adv", F.col("adv") + 1)
         .withColumn("dividend_yield", F.when(F.col("sid") % 4 != 0, F.col("dividend_yield") / 2)))
    return L.merge_sources(a, b, "sid", ["pl", "dividend_yield", "adv"], ("quote", "yearly"))


@query("derive_quote_ratios", "sid:i debt_ebitda:6 roic:6 pl:6", """
WITH q AS (SELECT sid, acctbal AS total_debt, nullif((sid * 7 % 20) * 100, 0) AS ebitda, nullif((sid % 4) / 10, 0) AS roic, nullif((sid % 3) / 20, 0) AS roa,
  CASE WHEN sid % 2 = 0 THEN nullif((sid % 9) * 3.5, 0) END AS pl, nullif((sid * 3 % 100) - 5.0, 0) AS fwd FROM securities)
SELECT sid, nullif(total_debt, 0) / ebitda AS debt_ebitda, coalesce(roic, roa) AS roic, coalesce(pl, CASE WHEN fwd > 0 AND fwd < 80 THEN fwd END) AS pl FROM q""")
def _(t):
    sid = F.col("sid")
    raw = t.securities.select(
        "sid", F.col("acctbal").alias("total_debt"), ((sid * 7 % 20) * 100).cast("double").alias("ebitda"), ((sid % 4) / 10).alias("roic"),
        ((sid % 3) / 20).alias("roa"), F.when(sid % 2 == 0, (sid % 9) * 3.5).alias("pl"), ((sid * 3 % 100) - 5.0).alias("forward_pl"))
    return L.derive_quote_ratios(raw)


@query("parse_quote_fields", "sid:i current_price:8 pl:10 dividend_yield:6 adv:2 market_cap:2", """
SELECT sid, close AS current_price, close / 7 AS pl, CASE WHEN dy > 1 THEN dy / 100 ELSE dy END AS dividend_yield,
 CASE WHEN sid % 3 <> 0 THEN volume ELSE quantity END AS adv, volume * 1000 AS market_cap FROM (SELECT *, quantity / 20 AS dy FROM bars)""")
def _(t):
    q = F.struct(F.col("close").alias("regularMarketPrice"), (F.col("close") / 7).alias("priceEarningsRatio"),
                 (F.col("quantity") / 20).alias("dividendYield"), F.when(F.col("sid") % 3 != 0, F.col("volume")).otherwise(0.0).alias("averageDailyVolume3Month"),
                 F.col("quantity").alias("regularMarketVolume"), (F.col("volume") * 1000).alias("marketCap"))
    return L.parse_quote_fields(t.bars.select("sid", q.alias("quote")))


@query("latest_past_event", "sid:i event_date:t days_since:i surprise:8", """
WITH e AS (SELECT sid, date AS event_date, max(disc * 20 - 1.5 + tax) AS surprise FROM trades WHERE flag = 'R' AND line = 1 GROUP BY ALL)
SELECT sid, event_date, DATE '2000-07-01' - event_date AS days_since, CASE WHEN abs(surprise) > 1 THEN surprise / 100 ELSE surprise END AS surprise
FROM e WHERE event_date < DATE '2000-07-01' QUALIFY row_number() OVER (PARTITION BY sid ORDER BY event_date DESC, surprise DESC) = 1""")
def _(t):
    e = t.trades.filter("flag = 'R' AND line = 1").groupBy("sid", F.col("date").alias("event_date")).agg(
        F.max(F.col("disc") * 20 - 1.5 + F.col("tax")).alias("surprise"))
    return L.latest_past_event(e, F.lit("2000-07-01").cast("date"))


@query("filter_liquidity", "sid:i adv:4", CLEAN_SQL + "SELECT * FROM derived WHERE adv IS NULL OR adv >= 5000000")
def _(t):
    return L.liquid(derived(t))


LEV_SQL = CLEAN_SQL + f""", med AS (SELECT sector, quantile_cont(debt_ebitda, 0.5) AS med FROM derived WHERE NOT ({FIN}) AND debt_ebitda IS NOT NULL GROUP BY sector)
SELECT d.* FROM derived d LEFT JOIN med USING (sector)
WHERE {FIN} OR NOT coalesce(debt_ebitda > 10 OR (debt_ebitda > 5 AND debt_ebitda > med * 1.5), false)"""


@query("filter_leverage_sector_relative", "sid:i debt_ebitda:6", LEV_SQL)
def _(t):
    return L.not_overlevered(derived(t), F.expr(FIN))


@query("filter_leverage_flat", "sid:i debt_ebitda:6", CLEAN_SQL + f"SELECT * FROM derived WHERE {FIN} OR coalesce(debt_ebitda <= 5, true)")
def _(t):
    return L.flat_leverage(derived(t), F.expr(FIN))


@query("filter_value_trap", "sid:i pl:6 roe:6", "SELECT * FROM fundamentals WHERE NOT coalesce(pl < 0 AND roe < -0.05, false)")
def _(t):
    return L.no_value_trap(t.fundamentals)


NF = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in L.FUNDAMENTAL_COLUMNS)


@query("filter_min_fundamentals", "sid:i n:i", CLEAN_SQL + f"SELECT sid, {NF} AS n FROM derived WHERE {NF} >= 5 OR ({FIN} AND {NF} >= 4)")
def _(t):
    return L.enough_fundamentals(derived(t), F.expr(FIN), 5).withColumn("n", L.n_fundamentals())


STALE_SQL = """
WITH b AS (SELECT sid, sno, CASE WHEN sid % 6 = 0 THEN 1.5 WHEN sid % 5 = 0 THEN 9.0 ELSE close END AS close FROM sbars),
r AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY sno DESC) AS j FROM b QUALIFY j <= 10),
g AS (SELECT sid, (SELECT max(sno) FROM sessions) - max(sno) AS lag, max(close) FILTER (j = 1) AS last, count(*) AS n,
  max(close) FILTER (j <= 5) - min(close) FILTER (j <= 5) AS s1, max(close) - min(close) AS s2 FROM r GROUP BY sid),
stale AS (SELECT sid, lag, CASE WHEN lag > 8 THEN 'lag' WHEN n >= CASE WHEN last < 2 THEN 10 ELSE 5 END AND CASE WHEN last < 2 THEN s2 ELSE s1 END <= 1e-6 * abs(last) THEN 'frozen' END AS reason FROM g)
SELECT * FROM stale WHERE reason IS NOT NULL"""


@query("filter_stale_prices", "sid:i lag:i reason:s", STALE_SQL)
def _(t):
    close = F.when(F.col("sid") % 6 == 0, 1.5).when(F.col("sid") % 5 == 0, 9.0).otherwise(F.col("close"))
    last = t.sessions.agg(F.max("sno").alias("last_sno"))
    return L.stale_prices(t.sbars.select("sid", "sno", close.alias("close")), last, max_lag=8)


@query("security_kind", "sid:i kind:s", """
SELECT sid, CASE WHEN sid % 6 = 0 THEN 'ON' WHEN sid % 6 = 1 THEN 'PN' WHEN sid % 6 = 2 THEN 'UNIT'
  ELSE CASE cls WHEN '3' THEN 'ON' WHEN '4' THEN 'PN' WHEN '11' THEN 'UNIT' END END AS kind FROM securities""")
def _(t):
    text = (F.when(F.col("sid") % 6 == 0, "Ações  Ordinárias").when(F.col("sid") % 6 == 1, "AÇÕES PREFERENCIAIS")
            .when(F.col("sid") % 6 == 2, "Certificado de Depósito").otherwise("outros"))
    return t.securities.select("sid", L.security_kind(text, F.col("cls")).alias("kind"))


@query("intraday_flag", "event_id:i intraday:b", """
SELECT event_id, isodow(ts) < 6 AND CAST(ts AS DATE) <> DATE '2024-01-01' AND strftime(ts, '%H:%M') >= '10:00' AND strftime(ts, '%H:%M') < '18:30' AS intraday FROM ticks""")
def _(t):
    return t.ticks.select("event_id", C.is_intraday(F.col("ts")).alias("intraday"))


@query("dedup_close_recommendations", "rec:i date:t", """
WITH RECURSIVE d AS (SELECT rec, date, row_number() OVER (PARTITION BY rec ORDER BY date) AS i FROM (SELECT DISTINCT o_custkey AS rec, CAST(o_orderdate AS DATE) AS date FROM orders)),
k AS (SELECT rec, i, date, date AS kept FROM d WHERE i = 1
 UNION ALL SELECT d.rec, d.i, d.date, CASE WHEN d.date - k.kept > 60 THEN d.date ELSE k.kept END FROM k JOIN d ON d.rec = k.rec AND d.i = k.i + 1)
SELECT rec, date FROM k WHERE date = kept""")
def _(t):
    recs = t.raw("orders").select(F.col("o_custkey").alias("rec"), F.to_date("o_orderdate").alias("date"))
    return L.keep_spaced(recs, "rec", "date", min_gap=60)


@query("latest_before", "rec:i rec_date:t n:i", """
SELECT rec, max(rec_date) AS rec_date, count(DISTINCT rec_date) AS n FROM baskets WHERE rec_date < DATE '1999-01-01' GROUP BY rec""")
def _(t):
    recs = t.baskets.select("rec", "rec_date").distinct().filter(F.col("rec_date") < "1999-01-01")
    return recs.groupBy("rec").agg(F.max("rec_date").alias("rec_date"), F.count("*").alias("n"))


@query("exclude_late_windows", "sid:i date:t", """
SELECT sid, date FROM sbars b WHERE (SELECT date FROM sessions s WHERE s.sno = b.sno + 5) < DATE '2001-06-01'""")
def _(t):
    ends = t.sessions.select((F.col("sno") - 5).alias("sno"), F.col("date").alias("window_end"))
    return t.sbars.join(ends, "sno").filter(F.col("window_end") < "2001-06-01").select("sid", "date")


# a yearly statement line per customer and year, for the growth and margin rules
ANNUAL_SQL = """SELECT o_custkey AS sid, year(o_orderdate) AS fy, round(sum(o_totalprice), 2) AS revenue, round(sum(CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END), 2) AS income FROM orders GROUP BY ALL"""


def annual(t):
    sign = F.when(F.col("o_orderkey") % 3 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return t.raw("orders").groupBy(F.col("o_custkey").alias("sid"), F.year("o_orderdate").alias("fy")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.round(F.sum(sign), 2).alias("income"))


def _back(col, k):
    w = Window.partitionBy("sid").orderBy("fy")
    return F.lag(col, k).over(w)


@query("agg_cagr_3y", "sid:i fy:i revenue_growth_3y:6 earnings_growth_3y:6", f"""
WITH a AS ({ANNUAL_SQL}), l AS (SELECT *, lag(revenue, 3) OVER w AS r3, lag(income, 3) OVER w AS i3 FROM a WINDOW w AS (PARTITION BY sid ORDER BY fy))
SELECT sid, fy, CASE WHEN r3 > 0 THEN greatest(-1, least(5, pow(greatest(revenue, 0) / r3, 1.0 / 3) - 1)) END AS revenue_growth_3y,
 CASE WHEN i3 > 0 AND income > 0 THEN greatest(-1, least(5, pow(income / i3, 1.0 / 3) - 1)) END AS earnings_growth_3y FROM l""")
def _(t):
    return (annual(t).withColumn("revenue_growth_3y", L.cagr3(F.col("revenue"), _back("revenue", 3)))
            .withColumn("earnings_growth_3y", F.when(F.col("income") > 0, L.cagr3(F.col("income"), _back("income", 3)))))


@query("agg_margin_avg", "sid:i margin:6", f"""
WITH a AS ({ANNUAL_SQL}) SELECT sid, avg(CASE WHEN revenue > 0 THEN income / revenue END) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY fy DESC) AS j FROM a) WHERE j <= 4 GROUP BY sid""")
def _(t):
    w = Window.partitionBy("sid").orderBy(F.col("fy").desc())
    rows = annual(t).withColumn("j", F.row_number().over(w)).filter("j <= 4")
    return rows.groupBy("sid").agg(F.avg(F.when(F.col("revenue") > 0, F.col("income") / F.col("revenue"))).alias("margin"))


@query("agg_asset_growth", "sid:i fy:i growth:6", f"""
WITH a AS ({ANNUAL_SQL}) SELECT sid, fy, revenue / lag(revenue) OVER (PARTITION BY sid ORDER BY fy) - 1 AS growth FROM a""")
def _(t):
    prev = _back("revenue", 1)
    return annual(t).withColumn("growth", F.col("revenue") / F.when(prev > 0, prev) - 1)


@query("agg_fcf_payout", "sid:i fy:i payout:6", f"""
WITH a AS ({ANNUAL_SQL}) SELECT sid, fy, CASE WHEN income > 0 AND abs(-revenue / 3) / income < 5 THEN abs(-revenue / 3) / income END AS payout FROM a""")
def _(t):
    ratio = F.abs(-F.col("revenue") / 3) / F.when(F.col("income") > 0, F.col("income"))
    return annual(t).withColumn("payout", F.when(ratio < 5, ratio))


@query("agg_analyst_score", "sid:i month:t score:6 trend:6", """
WITH c AS (SELECT sid, date_trunc('month', ts) AS month, date_trunc('week', ts) AS wk, event_type FROM ticks),
w AS (SELECT sid, wk, count_if(event_type = 'purchase') AS n5, count_if(event_type = 'signup') AS n4, count_if(event_type = 'view') AS n3, count_if(event_type = 'click') AS n2,
  count_if(event_type = 'error') AS n1, row_number() OVER (PARTITION BY sid ORDER BY wk DESC) AS j FROM c GROUP BY sid, wk),
g AS (SELECT sid, sum(5*n5 + 4*n4 + 3*n3 + 2*n2 + n1) FILTER (j <= 2) / nullif(sum(n5+n4+n3+n2+n1) FILTER (j <= 2), 0) AS score,
  sum(5*n5 + 4*n4 + 3*n3 + 2*n2 + n1) FILTER (j BETWEEN 3 AND 5) / nullif(sum(n5+n4+n3+n2+n1) FILTER (j BETWEEN 3 AND 5), 0) AS before FROM w GROUP BY sid)
SELECT sid, DATE '2024-01-01' AS month, score, score - before AS trend FROM g""")
def _(t):
    votes = {"purchase": 5, "signup": 4, "view": 3, "click": 2, "error": 1}
    wk = t.ticks.groupBy("sid", F.trunc("ts", "week").alias("wk")).agg(
        *[F.count_if(F.col("event_type") == k).alias(f"n{v}") for k, v in votes.items()])
    w = Window.partitionBy("sid").orderBy(F.col("wk").desc())
    wk = wk.withColumn("j", F.row_number().over(w))

    def score(rows):
        return L.analyst_score({v: F.sum(F.when(rows, F.col(f"n{v}"))) for v in votes.values()})

    g = wk.groupBy("sid").agg(score(F.col("j") <= 2).alias("score"), score(F.col("j").between(3, 5)).alias("before"))
    return g.select("sid", F.lit("2024-01-01").alias("month"), "score", (F.col("score") - F.col("before")).alias("trend"))


@query("agg_target_upside", "sid:i upside:6 dispersion:6", """
WITH g AS (SELECT sid, quantile_cont(px, 0.5) AS med, avg(px) AS mean, max(px) AS hi, min(px) AS lo, count(*) AS n, arg_max(px, event_id) AS cur FROM ticks GROUP BY sid),
x AS (SELECT *, coalesce(CASE WHEN n > 60 THEN med END, mean) AS target FROM g)
SELECT sid, target / cur - 1 AS upside, (hi - lo) / target AS dispersion FROM x WHERE cur > 0""")
def _(t):
    g = t.ticks.groupBy("sid").agg(F.percentile("px", 0.5).alias("med"), F.avg("px").alias("mean"), F.max("px").alias("hi"),
                                   F.min("px").alias("lo"), F.count("*").alias("n"), F.max_by("px", "event_id").alias("cur"))
    target = F.coalesce(F.when(F.col("n") > 60, F.col("med")), F.col("mean"))
    return (g.withColumn("target", target).filter("cur > 0")
            .select("sid", (F.col("target") / F.col("cur") - 1).alias("upside"), ((F.col("hi") - F.col("lo")) / F.col("target")).alias("dispersion")))
