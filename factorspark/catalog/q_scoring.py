"""Live scoring queries: one cross-section of all securities, keyed by a constant date."""

from pyspark.sql import functions as F

from factorspark.catalog.q_filters import CLEAN_SQL, FIN, derived
from factorspark.catalog.registry import query
from factorspark.operators import events as E
from factorspark.operators import live as L
from factorspark.operators import scoring as S
from factorspark.operators import xsection as X

KEYS = ["k"]


def sql_long(src: str, factors: dict) -> str:
    return " UNION ALL ".join(f"SELECT sid, sector, '{f}' AS factor, {f}::DOUBLE AS value, {w} AS weight, {d} AS direction FROM {src}" for f, (w, d) in factors.items())


def sql_adaptive(long: str) -> str:
    """Normalised rows of the live sector rule, from (sid, sector, factor, value, weight, direction)."""
    return f"""
lo AS (SELECT *, value * direction AS v FROM ({long})),
s1 AS (SELECT *, count(v) OVER w AS n, median(v) OVER w AS med, rank() OVER (PARTITION BY factor, sector, v IS NULL ORDER BY v) + (count(*) OVER (PARTITION BY factor, sector, v) - 1) / 2 AS rk,
  avg(v) OVER g AS gm, stddev_samp(v) OVER g AS gs, count(v) OVER g AS gn FROM lo WINDOW w AS (PARTITION BY factor, sector), g AS (PARTITION BY factor)),
s2 AS (SELECT *, median(abs(v - med)) OVER (PARTITION BY factor, sector) AS mad FROM s1),
s3 AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN n >= 5 AND mad > 0 THEN greatest(med - 3 * 1.4826 * mad, least(med + 3 * 1.4826 * mad, v)) ELSE v END AS cv FROM s2),
s4 AS (SELECT *, avg(cv) OVER w AS sm, stddev_samp(cv) OVER w AS ss FROM s3 WINDOW w AS (PARTITION BY factor, sector)),
s5 AS (SELECT *, CASE WHEN n >= 8 THEN 'zscore_sectoral' WHEN n >= 4 THEN 'percentile_sectoral' ELSE 'zscore_global' END AS method, CASE WHEN n >= 4 THEN n ELSE gn END AS n_peers,
  CASE WHEN v IS NULL THEN NULL WHEN n >= 8 THEN CASE WHEN ss = 0 THEN 0 ELSE greatest(-3, least(3, (cv - sm) / ss)) END WHEN n < 4 THEN CASE WHEN gs = 0 THEN 0 ELSE greatest(-3, least(3, (v - gm) / gs)) END END AS z,
  CASE WHEN v IS NOT NULL AND n BETWEEN 4 AND 7 THEN 100 * rk / n END AS pct FROM s4),
fz AS (SELECT *, coalesce(pct, (z + 3) / 6 * 100) AS score FROM s5)"""


def sql_global(name: str, long: str) -> str:
    return f"""
{name} AS (SELECT *, (CASE WHEN gs = 0 THEN 0 ELSE greatest(-3, least(3, (v - gm) / gs)) END + 3) / 6 * 100 * CASE WHEN v IS NOT NULL THEN 1 END AS score FROM (
  SELECT *, value * direction AS v, avg(value * direction) OVER g AS gm, stddev_samp(value * direction) OVER g AS gs FROM ({long}) WINDOW g AS (PARTITION BY factor)))"""


# Momentum and quality inputs stand in for the price-based metrics of the other queries.
LIVE_SQL = CLEAN_SQL + """,
live AS (SELECT * , (sid * 41 % 83) / 100 - 0.4::DOUBLE AS alpha_3m, CASE WHEN sid % 9 <> 0 THEN (sid * 59 % 97) / 100 - 0.5::DOUBLE END AS alpha_12m,
  CASE WHEN sid % 8 = 0 THEN (sid * 3 % 17) / 100 END AS pead_signal, (sid * 73 % 89) / 200 + 0.1::DOUBLE AS volatility FROM derived)
"""


def live(t):
    sid = F.col("sid")
    return (derived(t).withColumn("alpha_3m", (sid * 41 % 83) / 100 - 0.4)
            .withColumn("alpha_12m", F.when(sid % 9 != 0, (sid * 59 % 97) / 100 - 0.5))
            .withColumn("pead_signal", F.when(sid % 8 == 0, (sid * 3 % 17) / 100))
            .withColumn("volatility", (sid * 73 % 89) / 200 + 0.1).withColumn("k", F.lit(1)))


FUND_SQL = LIVE_SQL + "," + sql_adaptive(sql_long("live", S.FUNDAMENTAL)) + f""",
ac AS (SELECT fz.*, score IS NOT NULL AND NOT (fz.factor = 'roic' AND l.{FIN}) AND NOT (fz.factor = 'dividend_yield' AND (coalesce(l.fcf_payout > 1.2, false)
  OR coalesce(l.earnings_yield > 0 AND l.dividend_yield > 0 AND l.dividend_yield / l.earnings_yield > 1.5, false))) AS act FROM fz JOIN live l USING (sid)),
fs AS (SELECT sid, greatest(0, least(100, sum(weight * score) FILTER (act) / sum(weight) FILTER (act))) AS fundamental_score FROM ac GROUP BY sid)"""
MOM_SQL = sql_global("mz", sql_long("live", S.MOMENTUM)) + """,
ms AS (SELECT sid, greatest(0, least(100, sum(weight * score) / sum(weight) FILTER (score IS NOT NULL))) AS momentum_score FROM mz GROUP BY sid)"""
QUAL_SQL = sql_global("qz", sql_long("live", S.QUALITY)) + """,
qs AS (SELECT sid, greatest(0, least(100, sum(weight * score) / sum(weight) FILTER (score IS NOT NULL))) AS quality_score FROM qz GROUP BY sid)"""
TOTAL_SQL = FUND_SQL + "," + MOM_SQL + "," + QUAL_SQL + """,
tot AS (SELECT live.*, fundamental_score, momentum_score, quality_score, coalesce(greatest(0.5, least(1, sqrt(greatest(adv, 0) / 10000000))), 1) AS liquidity_penalty,
  round((0.45 * fundamental_score + 0.30 * momentum_score + 0.25 * quality_score) * coalesce(greatest(0.5, least(1, sqrt(greatest(adv, 0) / 10000000))), 1), 2) AS total_score
  FROM live JOIN fs USING (sid) JOIN ms USING (sid) JOIN qs USING (sid))"""


def scored(t):
    df = live(t)
    f, long = S.score_fundamental(df, KEYS, F.expr(FIN))
    m, _ = S.score_momentum(df, KEYS)
    q, _ = S.score_quality(df, KEYS)
    on = [*KEYS, "sid"]
    return S.total_score(df.join(f, on).join(m, on).join(q, on)), long


@query("score_fundamental", "sid:i fundamental_score:4", FUND_SQL + "SELECT * FROM fs")
def _(t):
    return S.score_fundamental(live(t), KEYS, F.expr(FIN))[0]


@query("score_momentum", "sid:i momentum_score:4", LIVE_SQL + "," + MOM_SQL + "SELECT * FROM ms")
def _(t):
    return S.score_momentum(live(t), KEYS)[0]


@query("score_quality", "sid:i quality_score:4", LIVE_SQL + "," + QUAL_SQL + "SELECT * FROM qs")
def _(t):
    return S.score_quality(live(t), KEYS)[0]


@query("score_total", "sid:i fundamental_score:4 momentum_score:4 quality_score:4 liquidity_penalty:4 total_score:2", TOTAL_SQL + "SELECT * FROM tot")
def _(t):
    return scored(t)[0]


@query("sort_by_score", "position:i sid:i total_score:2", TOTAL_SQL + """
SELECT row_number() OVER (ORDER BY total_score DESC, sid) AS position, sid, total_score FROM tot""")
def _(t):
    # the position of every security, without sorting the cross-section in one task
    s = scored(t)[0].withColumn("down", -F.col("total_score"))
    return X.with_first_rank(s, KEYS, "down", "sid", "position").orderBy("position")


@query("win_dominant_method", "sid:i method:s", FUND_SQL + """
SELECT sid, CASE WHEN bool_or(method = 'zscore_sectoral') THEN 'zscore_sectoral' WHEN bool_or(method = 'percentile_sectoral') THEN 'percentile_sectoral' ELSE 'zscore_global' END AS method FROM fz GROUP BY sid""")
def _(t):
    return S.dominant_method(S.normalized(live(t), KEYS, S.FUNDAMENTAL, "sector"), KEYS)


@query("topk_explain", "sid:i position:i factor:s score:5", FUND_SQL + """
SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY -abs(score - 50), factor) AS position, factor, score FROM fz WHERE score IS NOT NULL QUALIFY position <= 3""")
def _(t):
    return S.explain(S.normalized(live(t), KEYS, S.FUNDAMENTAL, "sector"), KEYS)


@query("norm_trace", "sid:i factor:s method:s n_peers:i score:5", FUND_SQL + "SELECT sid, factor, method, n_peers, score FROM fz")
def _(t):
    m = S.trace_map(S.normalized(live(t), KEYS, S.FUNDAMENTAL, "sector"), KEYS)
    return m.select("sid", F.explode("norm_details").alias("factor", "d")).select("sid", "factor", "d.*")


@query("conviction", "sid:i coverage:4 peers:i conviction:3 label:s", TOTAL_SQL + """,
cv AS (SELECT sid, count(score) / count(*) AS coverage, max(n_peers) AS peers,
  CASE WHEN bool_or(method = 'zscore_sectoral') THEN 1.0 WHEN bool_or(method = 'percentile_sectoral') THEN 0.7 ELSE 0.4 END AS ms FROM fz GROUP BY sid),
c2 AS (SELECT cv.sid, coverage, peers, round(0.35 * coverage + 0.25 * CASE WHEN peers >= 8 THEN 1 WHEN peers >= 4 THEN 0.6 ELSE 0.3 END + 0.20 * ms
  + 0.20 * CASE WHEN total_score IS NULL THEN 0 ELSE greatest(0, least(1, (total_score - 50) / 50)) END, 3) AS conviction FROM cv JOIN tot USING (sid))
SELECT *, CASE WHEN conviction >= 0.66 THEN 'Alta' WHEN conviction >= 0.40 THEN 'Média' ELSE 'Baixa' END AS label FROM c2""")
def _(t):
    s, long = scored(t)
    return S.conviction(long, s, KEYS)


@query("agg_metric_coverage", "metric:s coverage:6", CLEAN_SQL + " UNION ALL ".join(
    f"{'SELECT * FROM (' if i == 0 else ''}SELECT '{m}' AS metric, count({m}) / count(*) AS coverage FROM derived" for i, m in enumerate(L.FUNDAMENTAL_COLUMNS)) + ")")
def _(t):
    return S.metric_coverage(derived(t), list(L.FUNDAMENTAL_COLUMNS))


@query("agg_coverage", "sid:i collected:b scored:b missing:s", CLEAN_SQL + """,
p AS (SELECT sid FROM bars GROUP BY sid HAVING count(*) >= 500), fu AS (SELECT sid FROM derived WHERE (pl IS NOT NULL)::INT + (pvp IS NOT NULL)::INT + (roe IS NOT NULL)::INT
 + (roic IS NOT NULL)::INT + (debt_ebitda IS NOT NULL)::INT + (dividend_yield IS NOT NULL)::INT >= 4), s AS (SELECT sid FROM derived WHERE adv >= 5000000)
SELECT d.sid, p.sid IS NOT NULL AND fu.sid IS NOT NULL AS collected, s.sid IS NOT NULL AS scored,
 CASE WHEN p.sid IS NULL THEN 'no_price_history' WHEN fu.sid IS NULL THEN 'no_fundamentals' WHEN s.sid IS NULL THEN 'filtered_out' END AS missing
FROM derived d LEFT JOIN p USING (sid) LEFT JOIN fu USING (sid) LEFT JOIN s USING (sid)""")
def _(t):
    d = derived(t)
    priced = t.bars.groupBy("sid").agg(F.count("*").alias("n")).filter("n >= 500")
    return S.coverage_report(d, priced, d.filter(L.n_fundamentals() >= 4), L.liquid(d))


SETS_SQL = """
WITH c AS (SELECT DISTINCT sno, sid FROM bars JOIN sessions USING (date)), p AS (SELECT sno + 1 AS sno, sid FROM c WHERE sno < (SELECT max(sno) FROM sessions)),
f AS (SELECT * FROM c WHERE sno > 1)
"""


def _sets(t):
    """Names traded on each session, and on the session before it."""
    c = t.bars.select("sid", "date").join(t.sessions.select("date", "sno"), "date").select("sno", "sid").distinct()
    last = t.sessions.agg(F.max("sno").alias("last"))
    p = c.join(last, F.col("sno") < F.col("last")).select((F.col("sno") + 1).alias("sno"), "sid")
    return p, c.filter("sno > 1")


@query("set_diff", "sno:i sid:i side:s", SETS_SQL + """
SELECT sno, sid, 'exit' AS side FROM (SELECT * FROM p EXCEPT SELECT * FROM f) UNION ALL SELECT sno, sid, 'entry' FROM (SELECT * FROM f EXCEPT SELECT * FROM p)""")
def _(t):
    return E.rotation(*_sets(t), ["sno", "sid"])


@query("set_intersect", "sno:i sid:i", SETS_SQL + "SELECT * FROM p INTERSECT SELECT * FROM f")
def _(t):
    p, c = _sets(t)
    return p.intersect(c)


@query("union_all", "form:s n:i value:2", "SELECT form, count(*) AS n, round(sum(value), 2) AS value FROM (SELECT form, value FROM order_docs WHERE form = 'DFP' UNION ALL SELECT form, value FROM order_docs WHERE form = 'ITR' UNION ALL SELECT 'X', value FROM order_docs) GROUP BY form")
def _(t):
    d = t.order_docs.select("form", "value")
    parts = d.filter("form = 'DFP'").unionByName(d.filter("form = 'ITR'")).unionByName(d.select("value"), allowMissingColumns=True)
    return parts.groupBy(F.coalesce("form", F.lit("X")).alias("form")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query("union_distinct", "issuer:i dt_refer:t form:s", "SELECT issuer, dt_refer, form FROM order_docs WHERE version % 2 = 0 UNION SELECT issuer, dt_refer, form FROM order_docs WHERE version % 3 = 0")
def _(t):
    d = t.order_docs.select("issuer", "dt_refer", "form", "version")
    return d.filter("version % 2 = 0").drop("version").union(d.filter("version % 3 = 0").drop("version")).distinct()


@query("agg_value_counts", "sector:s n:i", "SELECT sector, count(*) AS n FROM securities GROUP BY sector")
def _(t):
    return t.securities.groupBy("sector").agg(F.count("*").alias("n"))


@query("join_broadcast_map", "sid:i theme:s", "SELECT sid, CASE sector WHEN 'ASIA' THEN 'financials' WHEN 'EUROPE' THEN 'industrials' ELSE 'other' END AS theme FROM securities")
def _(t):
    return E.with_theme(t.securities.drop("theme"), {"ASIA": "financials", "EUROPE": "industrials"})


PEAD_SQL = """
WITH ev AS (SELECT sid, max(date) AS event_date FROM trades WHERE flag = 'R' AND line = 1 AND date < DATE '2000-06-01' GROUP BY sid),
r AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY date) AS i, count(*) OVER (PARTITION BY sid) AS n, lag(close) OVER w AS p0, lead(close) OVER w AS p1 FROM bars WINDOW w AS (PARTITION BY sid ORDER BY date)),
h AS (SELECT ev.sid, ev.event_date, r.date, r.i, r.n, p0, p1 FROM ev JOIN r ON r.sid = ev.sid AND r.date >= ev.event_date QUALIFY row_number() OVER (PARTITION BY ev.sid ORDER BY r.date) = 1),
x AS (SELECT date, lag(close) OVER (ORDER BY sno) AS m0, lead(close) OVER (ORDER BY sno) AS m1 FROM index_close),
e AS (SELECT h.*, m0, m1, x.date AS xd, (DATE '2000-06-01' - event_date) * 5 / 7 AS bd FROM h JOIN x ON x.date >= h.event_date QUALIFY row_number() OVER (PARTITION BY h.sid ORDER BY x.date) = 1)
SELECT sid, (p1 / p0 - m1 / m0) * greatest(0, least(1, (60 - bd) / 55)) AS pead_signal FROM e
WHERE bd BETWEEN 5 AND 60 AND date - event_date <= 3 AND i >= 2 AND i <= n - 1 AND p0 > 0 AND p1 > 0"""


@query("pead_signal", "sid:i pead_signal:6", PEAD_SQL)
def _(t):
    ev = t.trades.filter("flag = 'R' AND line = 1 AND date < '2000-06-01'").groupBy("sid").agg(F.max("date").alias("event_date"))
    return E.pead_signal(ev, t.bars.select("sid", "date", "close"), t.index_close.select("date", "close"), F.lit("2000-06-01").cast("date"))


@query("join_event_nearest", "sid:i event_date:t session:t", """
WITH ev AS (SELECT DISTINCT sid, date - 2 AS event_date FROM trades WHERE flag = 'R' AND line = 1)
SELECT sid, event_date, session FROM (SELECT ev.*, (SELECT min(date) FROM bars b WHERE b.sid = ev.sid AND b.date >= ev.event_date) AS session FROM ev) WHERE session - event_date <= 3""")
def _(t):
    ev = t.trades.filter("flag = 'R' AND line = 1").select("sid", F.date_sub("date", 2).alias("event_date")).distinct()
    return E.nearest_session(ev, t.bars.select("sid", "date"), 3).withColumnRenamed("date_matched", "session")


ENTRY_SQL = """
WITH r AS (SELECT o_orderkey AS rec, o_orderdate + INTERVAL (o_orderkey % 24) HOUR AS run_at FROM orders)
SELECT rec, CASE WHEN hour(run_at) >= 17 THEN (SELECT min(date) FROM sessions s WHERE s.date > CAST(run_at AS DATE)) ELSE (SELECT min(date) FROM sessions s WHERE s.date >= CAST(run_at AS DATE)) END AS entry FROM r"""


@query("join_entry_session", "rec:i entry:t", ENTRY_SQL)
def _(t):
    runs = t.raw("orders").select(F.col("o_orderkey").alias("rec"), F.expr("o_orderdate + make_interval(0, 0, 0, 0, o_orderkey % 24)").alias("run_at"))
    return E.entry_session(runs, t.sessions).withColumnRenamed("entry_date", "entry")
