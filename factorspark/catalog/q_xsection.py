"""Cross-section queries."""

from pyspark.sql import functions as F

from factorspark.catalog.q_scalars import sql_ppf
from factorspark.catalog.registry import query
from factorspark.operators import xsection as X

WINSOR_SQL = """
WITH m AS (SELECT *, median(value) OVER () AS med FROM supplier_x), d AS (SELECT *, median(abs(value - med)) OVER () * 1.4826 AS mad FROM m),
w AS (SELECT sid, sector, value, CASE WHEN mad > 0 THEN greatest(med - {k} * mad, least(med + {k} * mad, value)) ELSE value END AS w FROM d)
"""


@query("win_mad_winsor", "sid:i w:4", WINSOR_SQL.format(k=1) + "SELECT sid, w FROM w")
def _(t):
    return X.mad_winsor(t.supplier_x.withColumn("k", F.lit(1)), ["k"], "value", 1.0)


@query("win_average_rank", "sid:i sector:i rank:2 n:i", """
SELECT sid, sector, rank() OVER w + (count(*) OVER (PARTITION BY sector, v) - 1) / 2 AS rank, count(*) OVER (PARTITION BY sector) AS n
FROM (SELECT sid, sector, round(value / 2000) AS v FROM supplier_x) WINDOW w AS (PARTITION BY sector ORDER BY v)""")
def _(t):
    df = t.supplier_x.withColumn("v", F.round(F.col("value") / 2000))
    return X.with_average_rank(df, ["sector"], "v", "rank", "n")


@query("win_trade_price_rank", "sid:i date:t line:i orderkey:i part:i rank:1", """
SELECT sid, date, line, orderkey, part, rank() OVER (ORDER BY px) + (count(*) OVER (PARTITION BY px) - 1) / 2 AS rank FROM trades""")
def _(t):
    tr = t.trades.select("sid", "date", "line", "orderkey", F.col("seq.l_partkey").alias("part"), "px").withColumn("k", F.lit(1))
    return X.with_average_rank(tr, ["k"], "px", "rank")


@query("agg_quantiles", "sector:i q05:6 med:6 q95:6", """
SELECT sector, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.95) AS q95 FROM supplier_x GROUP BY sector""")
def _(t):
    return X.quantiles(t.supplier_x, ["sector"], "value", {"q05": 0.05, "med": 0.5, "q95": 0.95})


@query("win_sector_z", "sid:i method:s n_peers:i z:6 pct:6 score:5", """
WITH b AS (SELECT sid, sector, CASE WHEN sid % 12 <> 0 THEN value END AS v FROM supplier_x),
s AS (SELECT *, count(v) OVER w AS n, median(v) OVER w AS med, rank() OVER (PARTITION BY sector, v IS NULL ORDER BY v) + (count(*) OVER (PARTITION BY sector, v) - 1) / 2 AS rk,
  avg(v) OVER () AS gm, stddev_samp(v) OVER () AS gs, count(v) OVER () AS gn FROM b WINDOW w AS (PARTITION BY sector)),
d AS (SELECT *, median(abs(v - med)) OVER (PARTITION BY sector) AS mad FROM s),
c AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN n >= 5 AND mad > 0 THEN greatest(med - 3 * 1.4826 * mad, least(med + 3 * 1.4826 * mad, v)) ELSE v END AS cv FROM d),
e AS (SELECT *, avg(cv) OVER (PARTITION BY sector) AS sm, stddev_samp(cv) OVER (PARTITION BY sector) AS ss FROM c),
f AS (SELECT sid, v, CASE WHEN n >= 8 THEN 'zscore_sectoral' WHEN n >= 4 THEN 'percentile_sectoral' ELSE 'zscore_global' END AS method,
  CASE WHEN n >= 4 THEN n ELSE gn END AS n_peers, CASE WHEN v IS NULL THEN NULL WHEN n >= 8 THEN greatest(-3, least(3, (cv - sm) / ss)) WHEN n < 4 THEN greatest(-3, least(3, (v - gm) / gs)) END AS z,
  CASE WHEN v IS NOT NULL AND n BETWEEN 4 AND 7 THEN 100 * rk / n END AS pct FROM e)
SELECT *, coalesce(pct, (z + 3) / 6 * 100) AS score FROM f""")
def _(t):
    df = t.supplier_x.withColumn("v", F.when(F.col("sid") % 12 != 0, F.col("value"))).withColumn("k", F.lit(1))
    return X.normalize_adaptive(df, ["k"], "sector", "v")


@query("win_sector_z_study", "sid:i z:5", WINSOR_SQL.format(k=5) + f""",
s AS (SELECT sid, -w AS x, count(*) OVER p AS n, avg(-w) OVER p AS sm, stddev_samp(-w) OVER p AS ss, avg(-w) OVER () AS gm, stddev_samp(-w) OVER () AS gs,
  (rank() OVER (PARTITION BY sector ORDER BY -w) + (count(*) OVER (PARTITION BY sector, w) - 1) / 2 - 0.5::DOUBLE) / count(*) OVER p AS q FROM w WINDOW p AS (PARTITION BY sector))
SELECT sid, greatest(-3, least(3, CASE WHEN n >= 8 AND ss > 0 THEN (x - sm) / ss WHEN n >= 4 THEN {sql_ppf('q')} ELSE (x - gm) / gs END)) AS z FROM s""")
def _(t):
    return X.sector_adaptive_z(t.supplier_x.withColumn("k", F.lit(1)).withColumn("dir", F.lit(-1.0)), ["k"], "sector", "value", "dir")


@query("win_global_z", "sid:i live:6 study:6", WINSOR_SQL.format(k=5) + """
SELECT sid, greatest(-3, least(3, (value - avg(value) OVER ()) / stddev_samp(value) OVER ())) AS live, greatest(-3, least(3, (w - avg(w) OVER ()) / stddev_samp(w) OVER ())) AS study FROM w""")
def _(t):
    df = t.supplier_x.withColumn("k", F.lit(1))
    live = X.normalize_global(df, ["k"], "value").select("sid", "k", "value", F.col("z").alias("live"))
    return X.global_z(live, ["k"], "value", out="study")


MONTHLY_SQL = """WITH x AS (SELECT date_trunc('month', date) AS t, sid, sector, arg_max(close, date) / arg_min(open, date) - 1 AS v FROM spec_bars GROUP BY ALL)"""


def monthly(t):
    return t.spec_bars.groupBy(F.trunc("date", "month").alias("t"), "sid", "sector").agg(
        (F.max_by("close", "date") / F.min_by("open", "date") - 1).alias("v"))


@query("win_sector_neutral", "t:t sid:i neutral:6", MONTHLY_SQL + """,
r AS (SELECT *, (rank() OVER (PARTITION BY t ORDER BY v) + (count(*) OVER (PARTITION BY t, v) - 1) / 2) / count(*) OVER (PARTITION BY t) AS p FROM x)
SELECT t, sid, p - avg(p) OVER (PARTITION BY t, sector) AS neutral FROM r""")
def _(t):
    return X.sector_neutral(monthly(t), ["t"], "sector", "v")


@query("win_quintile", "t:t sid:i bucket:i", MONTHLY_SQL + """,
r AS (SELECT t, sid, row_number() OVER (PARTITION BY t ORDER BY round(v, 1), sid) AS r, count(*) OVER (PARTITION BY t) AS n FROM x)
SELECT t, sid, CASE WHEN n >= 15 THEN greatest(1, ceil(5 * (r - 1) / (n - 1))) END AS bucket FROM r""")
def _(t):
    df = monthly(t).withColumn("v", F.round("v", 1))
    return X.quintiles(df, ["t"], "v", "sid")
