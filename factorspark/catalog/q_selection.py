"""Selection queries: every month is one cross-section."""

from pyspark.sql import functions as F

from factorspark.catalog.registry import query
from factorspark.operators import selection as L

SCORED_SQL = """
WITH sc AS (SELECT date_trunc('month', date) AS t, sid, root AS company, sector, CASE WHEN sid % 11 = 0 THEN '' ELSE subsector END AS subsector, theme,
  round(50 + 45 * tanh(arg_max(close, date) / arg_min(open, date) - 1), 2) AS score FROM spec_bars GROUP BY ALL)
"""


def monthly_scores(t):
    ret = F.max_by("close", "date") / F.min_by("open", "date") - 1
    return t.spec_bars.groupBy(F.trunc("date", "month").alias("t"), "sid", F.col("root").alias("company"), "sector",
                               F.when(F.col("sid") % 11 == 0, "").otherwise(F.col("subsector")).alias("subsector"), "theme").agg(
        F.round(50 + 45 * F.tanh(ret), 2).alias("score"))


@query("topk_portfolio", "t:t rank:i sid:i score:2", SCORED_SQL + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, sid) AS rank FROM sc) WHERE rank <= 5")
def _(t):
    return L.top_n(monthly_scores(t), ["t"], "score", 5)


BAND_SQL = SCORED_SQL + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, sid) AS rank FROM sc), inc AS (SELECT t + INTERVAL 1 MONTH AS t, sid FROM rk WHERE rank <= 10),
b AS (SELECT sc.*, score + CASE WHEN inc.sid IS NOT NULL AND score >= 50 THEN 5 ELSE 0 END AS adjusted FROM sc LEFT JOIN inc USING (t, sid))
"""


@query("turnover_band", "t:t position:i sid:i score:2 adjusted:2", BAND_SQL + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY adjusted DESC, sid) AS position FROM b) WHERE position <= 10")
def _(t):
    s = monthly_scores(t)
    held = L.top_n(s, ["t"], "score", 10).select(F.add_months("t", 1).alias("t"), "sid")
    return L.top_n(L.turnover_band(s, held, ["t"]), ["t"], "adjusted", 10, out="position")


def _cascade(cond):
    return f"""SELECT v.t, v.mode, v.pos + 1, CASE WHEN len(v.sel) < 5 AND {cond} AND (v.mode = 2 OR o.score >= 50)
      AND len(list_filter(v.sel, lambda x: x.company = o.company)) = 0 AND len(list_filter(v.sel, lambda x: x.sector = o.sector)) < 2
      AND len(list_filter(v.sel, lambda x: x.theme = o.theme)) < 2 THEN list_append(v.sel, {{'sid': o.sid, 'company': o.company, 'sector': o.sector, 'subsector': o.subsector, 'theme': o.theme, 'score': o.score}}) ELSE v.sel END
    FROM v JOIN o ON o.t = v.t AND o.pos = v.pos + 1"""


DIVERSE_SQL = SCORED_SQL.replace("WITH sc", "WITH RECURSIVE sc") + f""",
o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, sid) AS pos FROM sc),
v AS (SELECT t, mode, CAST(0 AS BIGINT) AS pos, list_filter([{{'sid': CAST(0 AS BIGINT), 'company': '', 'sector': '', 'subsector': '', 'theme': '', 'score': CAST(0 AS DOUBLE)}}], lambda x: false) AS sel
      FROM (SELECT DISTINCT t FROM sc), (VALUES (0), (1), (2)) m(mode)
  UNION ALL {_cascade("(v.mode > 0 OR o.subsector = '' OR len(list_filter(v.sel, lambda x: x.subsector = o.subsector)) < 1)")}),
fin AS (SELECT t, mode, arg_max(sel, pos) AS sel FROM v GROUP BY t, mode),
ch AS (SELECT t, min(CASE WHEN len(sel) = 5 THEN mode END) AS mode FROM fin GROUP BY t),
rest AS (SELECT f.t, list(o.sid ORDER BY o.pos) AS r FROM fin f JOIN o USING (t) WHERE mode = 2 AND NOT list_contains([x.sid FOR x IN f.sel], o.sid) GROUP BY f.t),
fl AS (SELECT ch.t, coalesce(ch.mode, 3) AS step, CASE WHEN ch.mode IS NOT NULL THEN [x.sid FOR x IN f.sel] ELSE list_slice(list_concat([x.sid FOR x IN f.sel], r), 1, 5) END AS sel
  FROM ch JOIN fin f ON f.t = ch.t AND f.mode = coalesce(ch.mode, 2) LEFT JOIN rest ON rest.t = ch.t),
picks AS (SELECT t, step, unnest(generate_series(1, len(sel))) AS position, unnest(sel) AS sid FROM fl),
pk AS (SELECT picks.*, sc.company, sc.sector, sc.subsector, sc.theme, sc.score FROM picks JOIN sc USING (t, sid))
"""


def picks(t):
    return L.select_diverse(monthly_scores(t), ["t"])


@query("topk_diverse", "t:t step:i position:i sid:i score:2", DIVERSE_SQL + "SELECT * FROM pk")
def _(t):
    return picks(t)


DIAG_SQL = DIVERSE_SQL + """,
dg AS (SELECT t, min(score) AS min_score, count_if(score < 50) AS below_threshold, count_if(sid % 7 / 10 > 0.2) AS exporters, count_if(sid % 7 / 10 - 0.5 < -0.2) AS dummy FROM pk GROUP BY t),
th AS (SELECT t, arg_max(theme, (c, theme)) AS dominant_theme, max(c) AS dominant_count FROM (SELECT t, theme, count(*) AS c FROM pk GROUP BY ALL) GROUP BY t),
sk AS (SELECT t, max(c) AS top_sector_count FROM (SELECT t, sector, count(*) AS c FROM pk GROUP BY ALL) GROUP BY t),
di AS (SELECT * FROM dg JOIN th USING (t) JOIN sk USING (t))
"""


@query("topk_diagnostics", "t:t dominant_theme:s dominant_count:i top_sector_count:i min_score:2 below_threshold:i exporters:i", DIAG_SQL + "SELECT * FROM di")
def _(t):
    return L.diagnostics(picks(t).withColumn("fx_corr", F.col("sid") % 7 / 10), ["t"])


@query("quality_flags", "t:t flag:s", DIAG_SQL + """, cv AS (SELECT t, count_if(score > 30) / count(*) AS cov FROM sc GROUP BY t)
SELECT t, 'low_coverage' AS flag FROM cv WHERE cov < 0.6 UNION ALL SELECT t, 'theme_concentration' FROM di WHERE dominant_count >= 3 AND dominant_theme <> 'other'
UNION ALL SELECT t, 'sector_concentration' FROM di WHERE top_sector_count >= 3 UNION ALL SELECT t, 'below_threshold' FROM di WHERE below_threshold > 0""")
def _(t):
    cov = monthly_scores(t).groupBy("t").agg((F.count_if(F.col("score") > 30) / F.count("*")).alias("cov"))
    return L.quality_flags(L.diagnostics(picks(t), ["t"]).join(cov, "t"), F.col("cov"), ["t"])


@query("best_worst", "date:t best:i best_ret:6 worst:i worst_ret:6", """
WITH r AS (SELECT date, sid, close / open - 1 AS r FROM bars)
SELECT date, arg_max(sid, (r, sid)) AS best, max(r) AS best_ret, arg_min(sid, (r, sid)) AS worst, min(r) AS worst_ret FROM r GROUP BY date""")
def _(t):
    r = F.struct((F.col("close") / F.col("open") - 1).alias("r"), "sid")
    return t.bars.groupBy("date").agg(F.max(r).alias("b"), F.min(r).alias("w")).select(
        "date", F.col("b.sid").alias("best"), F.col("b.r").alias("best_ret"), F.col("w.sid").alias("worst"), F.col("w.r").alias("worst_ret"))


@query("last_n", "sid:i date:t close:8", "SELECT sid, date, close FROM bars QUALIFY row_number() OVER (PARTITION BY sid ORDER BY date DESC) <= 6")
def _(t):
    from factorspark.operators.volatility import last_rows
    return last_rows(t.bars, 6)
