"""Factor panel queries."""

from pyspark.sql import functions as F

from factorspark.catalog.q_portfolio import MIX_SQL
from factorspark.catalog.q_prices import LIQ_SQL, PASSES_SQL, UNIVERSE, sid_cash, sid_stock
from factorspark.catalog.q_scalars import sql_ppf
from factorspark.catalog.q_windows import index_regime
from factorspark.catalog.registry import query
from factorspark.operators import portfolio as W
from factorspark.operators import prices as P
from factorspark.operators import selection as L
from factorspark.operators import timeseries as ts
from factorspark.plans import panel as N
from factorspark.plans import panel_table as T
from factorspark.plans import rules as U
from factorspark.session import cut_lineage, shared_dir

FILL, FINANCIAL = 20, "1-URGENT"
DOCS = ["ni", "equity", "ebit", "gross_profit", "ocf", "assets", "debt", "cash", "dna", "rev_ttm", "shares"]
DOC_EXPR = {"ni": "value * 0.1 - 12000", "equity": "value * 1.5 - 30000", "ebit": "value * 0.18", "gross_profit": "value * 0.3", "ocf": "value * 0.12",
            "assets": "value * 2 + 100000", "debt": "CASE WHEN issuer % 4 <> 0 THEN sqrt(value) * 300 END", "cash": "value * 0.2",
            "dna": "CASE WHEN issuer % 3 <> 0 THEN value * 0.03 END", "rev_ttm": "value", "shares": "value / 40 + 1000"}
PANEL_COLS = ["MOM", "REV", "ret3", "ret6", "VOL", "vol180", "vol126", "BETA", "LIQ", "adv30", "dy", "px", "fwd"]

PANEL_SQL = LIQ_SQL + f""",
pm AS (SELECT date, sno, lag(date) OVER (ORDER BY date) AS t_prev, lag(sno) OVER (ORDER BY date) AS prev_sno FROM sessions),
me0 AS (SELECT date_trunc('month', date) AS month, max(date) AS t, max(sno) AS t_sno, arg_max(t_prev, date) AS t_prev, arg_max(prev_sno, date) AS prev_sno FROM pm GROUP BY 1),
me AS (SELECT *, lead(t) OVER (ORDER BY t) AS t_next FROM me0),
mr AS (SELECT t, (SELECT max(rebalance_date) FROM uni WHERE rebalance_date <= t) AS rebalance_date FROM me WHERE prev_sno >= 261),
pr AS (SELECT me.*, u.sid FROM mr JOIN uni u USING (rebalance_date) JOIN me USING (t)),
dv AS (SELECT s.sid, e.last_date_prior AS date, sum(e.value) AS dividend FROM cash_events e JOIN securities s ON s.root = e.root AND s.kind = e.type GROUP BY ALL),
adj AS MATERIALIZED ({PASSES_SQL} SELECT sid, date, first_value(close) OVER w / coalesce(product(1 + coalesce(ret_total, 0)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS tr
  FROM passes WINDOW w AS (PARTITION BY sid ORDER BY date DESC)),
pb AS (SELECT b.sid, b.date, b.sno, b.close, adj.tr, b.volume, adj.tr / lag(adj.tr) OVER (PARTITION BY b.sid ORDER BY b.sno) - 1 AS ret, coalesce(dv.dividend, 0) AS dividend
  FROM sbars b JOIN adj USING (sid, date) LEFT JOIN dv USING (sid, date)),
im AS (SELECT sno, close / lag(close) OVER (ORDER BY sno) - 1 AS m FROM index_close),
iv AS (SELECT sno, m, var_samp(m) OVER (ORDER BY sno ROWS 251 PRECEDING) AS m_var FROM im),
x AS (SELECT pr.t, pr.sid, pr.t_prev, pr.prev_sno, b.sno, b.date, b.close, b.tr, b.volume, b.ret, b.dividend, iv.m, pr.prev_sno - b.sno AS k
  FROM pr JOIN pb b ON b.sid = pr.sid AND b.sno <= pr.prev_sno AND b.sno > pr.prev_sno - 400 JOIN iv ON iv.sno = b.sno),
sg0 AS (SELECT t, sid, t_prev, prev_sno, arg_max(close, sno) FILTER (k <= {FILL}) AS px, arg_max(tr, sno) FILTER (k <= {FILL}) AS p0, arg_max(tr, sno) FILTER (k BETWEEN 21 AND 21 + {FILL}) AS p21,
  arg_max(tr, sno) FILTER (k BETWEEN 63 AND 63 + {FILL}) AS p63, arg_max(tr, sno) FILTER (k BETWEEN 126 AND 126 + {FILL}) AS p126,
  arg_max(tr, sno) FILTER (k BETWEEN 252 AND 252 + {FILL}) AS p252, stddev_samp(ret) FILTER (k < 252) * sqrt(252) AS VOL, stddev_samp(ret) FILTER (k < 180) * sqrt(252) AS vol180,
  stddev_samp(ret) FILTER (k < 126) * sqrt(252) AS vol126, CASE WHEN count(ret) FILTER (k < 252) > 30 THEN covar_samp(ret, m) FILTER (k < 252) END AS cov,
  avg(volume) FILTER (k < 63) AS LIQ, avg(volume) FILTER (k < 30) AS adv30, sum(dividend) FILTER (t_prev - date < 365) AS dividends FROM x GROUP BY ALL),
sg AS (SELECT pr.t, pr.sid, pr.t_prev, px, p21 / p252 - 1 AS MOM, p0 / p21 - 1 AS REV, p21 / p63 - 1 AS ret3, p21 / p126 - 1 AS ret6, VOL, vol180, vol126, cov / iv.m_var AS BETA,
  LIQ, adv30, coalesce(dividends, 0) / px AS dy FROM pr LEFT JOIN sg0 USING (t, sid) LEFT JOIN iv ON iv.sno = pr.prev_sno),
mp AS (SELECT sid, date_trunc('month', date) AS month, max(sno) AS s, arg_max(tr, sno) AS c FROM pb GROUP BY ALL),
fw AS (SELECT pr.t, pr.sid, CASE WHEN n.c IS NULL THEN 0 ELSE n.c / CASE WHEN pr.t_sno - a.s <= {FILL} THEN a.c END - 1 END AS fwd FROM pr
  LEFT JOIN mp a ON a.sid = pr.sid AND a.month = pr.month LEFT JOIN mp n ON n.sid = pr.sid AND n.month = pr.month + INTERVAL 1 MONTH WHERE pr.t_next IS NOT NULL),
lk AS (SELECT m.t, m.sid, m.issuer, g.segment AS sector FROM (SELECT pr.t, pr.sid, l.issuer FROM pr LEFT JOIN listings l ON l.sid = pr.sid AND pr.t >= l.start AND (l.finish IS NULL OR pr.t <= l.finish)) m
  LEFT JOIN (SELECT *, lead(year) OVER (PARTITION BY issuer ORDER BY year) AS next_year FROM segments) g ON g.issuer = m.issuer AND year(m.t) >= g.year AND (g.next_year IS NULL OR year(m.t) < g.next_year)),
fd AS (SELECT issuer, dt_refer, available_from, {", ".join(f"{e} AS {n}" for n, e in DOC_EXPR.items())} FROM filings),
fa AS (SELECT pr.t, pr.sid, fd.* EXCLUDE (issuer) FROM pr JOIN lk USING (t, sid) JOIN fd ON fd.issuer = lk.issuer AND fd.available_from <= pr.t_prev AND pr.t_prev - fd.dt_refer <= 500
  QUALIFY row_number() OVER (PARTITION BY pr.t, pr.sid ORDER BY dt_refer DESC, available_from DESC) = 1),
p0 AS (SELECT sg.*, fw.fwd, lk.issuer, coalesce(lk.sector, '?') AS sector, coalesce(lk.sector = '1-URGENT', false) AS is_fin, fa.dt_refer AS doc_ref, {", ".join(f"fa.{d}" for d in DOCS)}, fa.shares * sg.px AS mcap,
   rp.rev_ttm AS rev_base, rp.assets AS assets_base
  FROM sg JOIN fw USING (t, sid) JOIN lk USING (t, sid) LEFT JOIN fa USING (t, sid) LEFT JOIN (SELECT issuer, dt_refer, arg_max(rev_ttm, available_from) AS rev_ttm, arg_max(assets, available_from) AS assets FROM fd GROUP BY ALL) rp
   ON rp.issuer = lk.issuer AND rp.dt_refer = last_day(fa.dt_refer - INTERVAL 12 MONTH)),
p1 AS (SELECT * EXCLUDE (rev_base, assets_base), rev_ttm / nullif(greatest(rev_base, 0), 0) - 1 AS rev_growth, assets / nullif(greatest(assets_base, 0), 0) - 1 AS asset_growth,
  CASE WHEN mcap > 0 THEN mcap END AS cap, coalesce(equity, 0) + coalesce(debt, 0) - coalesce(cash, 0) AS ic, ebit + coalesce(dna, 0) AS ebitda FROM p0),
panel AS (SELECT *, ni / cap AS EY, equity / cap AS BP, CASE WHEN NOT is_fin AND cap + coalesce(debt, 0) - coalesce(cash, 0) > 0 THEN ebit / (cap + coalesce(debt, 0) - coalesce(cash, 0)) END AS EBIT_EV,
  CASE WHEN equity > 0 THEN ni / equity END AS ROE, CASE WHEN NOT is_fin AND assets > 0 THEN gross_profit / assets END AS GP, CASE WHEN NOT is_fin AND assets > 0 THEN (ni - ocf) / assets END AS ACC,
  ln(cap) AS SIZE, CASE WHEN NOT is_fin AND ic > 0 THEN ebit * 0.66 / ic END AS ROIC, CASE WHEN NOT is_fin AND ebitda > 0 THEN (coalesce(debt, 0) - coalesce(cash, 0)) / ebitda END AS ND_EBITDA,
  CASE WHEN ni > 0 THEN cap / ni END AS PE FROM p1)
"""


def documents(t, issuers=None):
    """Documents with their values. Those of issuers outside ``issuers`` (rows with an _issuer) are left out before versions are exchanged."""
    kept = t.filings if issuers is None else t.filings_of(t.order_docs.join(issuers, F.col("issuer").eqNullSafe(F.col("_issuer")), "left_semi"))
    return kept.select("issuer", "dt_refer", "available_from", *[F.expr(e).alias(n) for n, e in DOC_EXPR.items()])


def panel_bars(t, only=None):
    """Bars with the series adjusted for splits and dividends, and the dividends themselves.

    Adjustment looks at one security at a time, so bars and events that no branch reads later, those of securities
    outside ``only`` (rows with a sid), are left out before they are exchanged and sorted.
    """
    pairs = t.securities.select("root", F.col("kind").alias("type"), "sid")
    held = (lambda df: df) if only is None else (lambda df: df.join(only, "sid", "left_semi"))
    div = held(t.cash_events.join(pairs, ["root", "type"])).groupBy("sid", F.col("last_date_prior").alias("date")).agg(F.sum("value").alias("dividend"))
    adj = P.adjusted_prices(t.with_spec(held(t.bars)), held(sid_cash(t)), held(sid_stock(t)))
    b = held(t.sbars).join(adj.select("sid", "date", "tr_close"), ["sid", "date"])
    b = b.select("sid", "date", "sno", "close", "tr_close", "volume", ts.returns("tr_close", ts.by_row()).alias("ret"))
    return b.join(div, ["sid", "date"], "left").withColumn("dividend", F.coalesce("dividend", F.lit(0.0)))


def panel_inputs(t):
    """Month ends, members, documents of issuers that a member stands for, and links of the panel; members and links are read by many branches and written out."""
    t.keep_bars("close", "volume", "trades", "mark")
    months = ts.month_ends(t.sessions)
    uni = P.universe_history(t.spec_bars, t.sessions, size=60, **UNIVERSE)
    members = cut_lineage(P.members_at(months.select("t"), uni).select("t", "sid"))
    links = cut_lineage(N.links_at(members, t.listings, t.segments, FINANCIAL))
    return months, members, documents(t, links.select(F.col("issuer").alias("_issuer")).distinct()), links


def with_ratios(p, docs):
    """Growth against the document a year before, market value, and the ratios."""
    prior = docs.groupBy("issuer", F.last_day(F.add_months("dt_refer", 12)).alias("doc_ref")).agg(
        F.max_by("rev_ttm", "available_from").alias("_rb"), F.max_by("assets", "available_from").alias("_ab"))
    p = p.join(prior, ["issuer", "doc_ref"], "left")
    p = (p.withColumn("rev_growth", F.col("rev_ttm") / F.when(F.col("_rb") > 0, F.col("_rb")) - 1)
         .withColumn("asset_growth", F.col("assets") / F.when(F.col("_ab") > 0, F.col("_ab")) - 1).drop("_rb", "_ab")
         .withColumn("mcap", F.col("shares") * F.col("px")))
    return N.derive_ratios(p)


def build_panel(t):
    months, members, docs, links = panel_inputs(t)
    return with_ratios(N.factor_panel(panel_bars(t, members.select("sid").distinct()), t.index_close.select("sno", "close"), months, members, docs, DOCS, links, fill=FILL, min_beta=30), docs)


@query("panel_by_month", "t:t sid:i MOM:5 VOL:5 BETA:5 px:8 dy:5 fwd:5 doc_ref:t EY:6 ROE:6", PANEL_SQL + "SELECT * FROM panel")
def _(t):
    """Built without the last year of bars first, then brought up to date.

    As in ``build_panel``, bars of securities that are no member of any month are left out; marks, updates and ratios read the documents six
    times, so these are written out.
    """
    months, members, docs, links = panel_inputs(t)
    docs = cut_lineage(docs)
    bars = cut_lineage(panel_bars(t, members.select("sid").distinct())).withColumn("month", F.date_format("date", "yyyy-MM"))
    cut = F.lit(t.bars.agg(F.add_months(F.trunc(F.max("date"), "month"), -12).alias("d")).first()["d"])
    table = T.PanelTable(t.spark, shared_dir(t.spark, "panel"), shared_dir(t.spark, "bars"))
    index = t.index_close.select("sno", "date", "close")
    for part, sessions in ((F.col("date") < cut, t.sessions.filter(F.col("date") < cut)), (F.col("date") >= cut, t.sessions)):
        bars.filter(part).repartition("month").write.mode("append").partitionBy("month").parquet(table.bars)
        ends = ts.month_ends(sessions)
        here = members.join(ends.select("t"), "t", "left_semi")
        table.update(index.join(sessions.select("sno"), "sno", "left_semi"), ends, here, docs, DOCS, links, fill=FILL, min_beta=30)
    return with_ratios(table.read(), docs)


@query("panel_links", "t:t sid:i issuer:i sector:s is_fin:b", """
WITH me AS (SELECT max(date) AS t FROM sessions GROUP BY date_trunc('month', date)),
m AS (SELECT me.t, s.sid, l.issuer FROM me, securities s LEFT JOIN listings l ON l.sid = s.sid AND me.t >= l.start AND (l.finish IS NULL OR me.t <= l.finish))
SELECT m.t, m.sid, m.issuer, g.segment AS sector, coalesce(g.segment = '1-URGENT', false) AS is_fin FROM m LEFT JOIN segments g ON g.issuer = m.issuer AND g.year = (SELECT max(year) FROM segments h WHERE h.issuer = m.issuer AND h.year <= year(m.t))""")
def _(t):
    days = ts.month_ends(t.sessions).agg(F.collect_list("t").alias("ts"))  # one row, a day for each month
    return N.links_at(t.securities.join(F.broadcast(days)).select(F.explode("ts").alias("t"), "sid"), t.listings, t.segments, FINANCIAL)


def panel(t):
    """The panel is read by many branches of a study, so it is written out once."""
    if "_panel" not in t.__dict__:
        t.__dict__["_panel"] = cut_lineage(build_panel(t))
    return t.__dict__["_panel"]


@query("factor_panel", "t:t sid:i " + " ".join(f"{c}:5" for c in PANEL_COLS if c not in ("LIQ", "adv30", "px")) + " px:8 LIQ:7 adv30:7 doc_ref:t EY:6 ROE:6", PANEL_SQL + "SELECT * FROM panel")
def _(t):
    return build_panel(t)


@query("derive_fundamental_ratios", "t:t sid:i " + " ".join(f"{c}:6" for c in ("EY", "BP", "EBIT_EV", "ROE", "GP", "ACC", "SIZE", "ROIC", "ND_EBITDA", "PE")), PANEL_SQL + "SELECT * FROM panel")
def _(t):
    return build_panel(t)


FILTER_SQL = PANEL_SQL + """,
ok AS (SELECT * FROM panel WHERE coalesce(adv30 >= 45000, false) AND NOT coalesce(NOT is_fin AND ND_EBITDA > 5, false) AND NOT coalesce(ni < 0 AND ROE < -0.05, false) AND NOT coalesce(PE > 80, false) AND NOT coalesce(ROE < -0.5, false))
"""


def scaled(p):
    """Test volumes are far below the market's: the volume rule is exercised on scaled volume."""
    return p.withColumn("adv30", F.col("adv30") * (5_000_000 / 45_000))


@query("study_filters", "t:t sid:i", FILTER_SQL + "SELECT * FROM ok")
def _(t):
    return scaled(panel(t)).filter(N.study_filter())


EVENTS_SQL = "SELECT sid, max(date) - 300 AS event_date FROM bars WHERE sid % 7 = 0 GROUP BY sid"


@query("drop_unpriced_event_month", "t:t sid:i fwd:5", PANEL_SQL + f""", ev AS ({EVENTS_SQL}), nx AS (SELECT t, lead(t) OVER (ORDER BY t) AS n FROM (SELECT DISTINCT t FROM panel))
SELECT p.t, p.sid, CASE WHEN ev.sid IS NULL THEN fwd END AS fwd FROM panel p JOIN nx USING (t) LEFT JOIN ev ON ev.sid = p.sid AND p.t < ev.event_date AND (n IS NULL OR n >= ev.event_date)""")
def _(t):
    ev = t.bars.filter("sid % 7 = 0").groupBy("sid").agg(F.date_sub(F.max("date"), 300).alias("event_date"))
    return N.drop_unpriced(panel(t), ev)


@query("agg_study_coverage", "t:t members:i linked:6 fundamentals:6 mcap:6", PANEL_SQL + """
SELECT t, count(*) AS members, count(doc_ref) / count(*) AS linked, count(ni) / count(*) AS fundamentals, count(mcap) / count(*) AS mcap FROM panel GROUP BY t""")
def _(t):
    return panel(t).groupBy("t").agg(F.count("*").alias("members"), *[F.avg(F.col(c).isNotNull().cast("double")).alias(a)
                                     for c, a in (("doc_ref", "linked"), ("ni", "fundamentals"), ("mcap", "mcap"))])


def _sql_value(f):
    return f"ln(greatest({f}, 1))" if f in ("LIQ", "adv30") else f


def sql_rows(factors):
    spec = {f: (v if isinstance(v, tuple) else (1.0, v)) for f, v in factors.items()}
    return " UNION ALL ".join(f"SELECT t, sid, sector, '{f}' AS factor, CASE WHEN {f} IS NOT NULL THEN {_sql_value(f)} END AS x, {w} AS weight, {d} AS dir FROM panel" for f, (w, d) in spec.items())


def sql_winsor(name, rows):
    return f"""
{name}_a AS (SELECT *, median(x) OVER (PARTITION BY t, factor) AS med FROM ({rows}) WHERE x IS NOT NULL),
{name}_b AS (SELECT *, median(abs(x - med)) OVER (PARTITION BY t, factor) * 1.4826 AS mad FROM {name}_a),
{name}_w AS (SELECT *, CASE WHEN mad > 0 THEN greatest(med - 5 * mad, least(med + 5 * mad, x)) ELSE x END * dir AS w FROM {name}_b)"""


def sql_global(name, rows):
    return sql_winsor(name, rows) + f""",
{name}_z AS (SELECT *, (w - avg(w) OVER g) / nullif(stddev_samp(w) OVER g, 0) AS z0 FROM {name}_w WINDOW g AS (PARTITION BY t, factor)),
{name} AS (SELECT *, CASE WHEN z0 IS NOT NULL THEN greatest(-3, least(3, z0)) END AS z FROM {name}_z)"""


def sql_sector(name, rows):
    return sql_winsor(name, rows) + f""",
{name}_s AS (SELECT *, count(*) OVER s AS n, avg(w) OVER s AS sm, stddev_samp(w) OVER s AS ss, avg(w) OVER g AS gm, stddev_samp(w) OVER g AS gs,
  (rank() OVER (PARTITION BY t, factor, sector ORDER BY w) + (count(*) OVER (PARTITION BY t, factor, sector, w) - 1) / 2 - 0.5::DOUBLE) / count(*) OVER s AS q
  FROM {name}_w WINDOW s AS (PARTITION BY t, factor, sector), g AS (PARTITION BY t, factor)),
{name}_z AS (SELECT *, CASE WHEN n >= 8 AND ss > 1e-12 THEN (w - sm) / ss WHEN n >= 4 THEN {sql_ppf('q')} WHEN gs > 1e-12 THEN (w - gm) / gs END AS z0 FROM {name}_s),
{name} AS (SELECT *, CASE WHEN z0 IS NOT NULL THEN greatest(-3, least(3, z0)) END AS z FROM {name}_z)"""


PILLAR_SQL = PANEL_SQL + "," + sql_sector("zf", sql_rows(N.FUND)) + "," + sql_global("zm", sql_rows(N.MOM)) + "," + sql_global("zq", sql_rows(N.QUAL)) + """,
pil AS (SELECT p.t, p.sid, p.fwd, p.adv30, p.vol126, p.is_fin, fund_z, mom_z, qual_z FROM panel p LEFT JOIN (SELECT t, sid, sum(weight * z) / sum(weight) FILTER (z IS NOT NULL) AS fund_z FROM zf GROUP BY ALL) USING (t, sid)
 LEFT JOIN (SELECT t, sid, sum(weight * z) / sum(weight) FILTER (z IS NOT NULL) AS mom_z FROM zm GROUP BY ALL) USING (t, sid) LEFT JOIN (SELECT t, sid, sum(weight * z) / sum(weight) FILTER (z IS NOT NULL) AS qual_z FROM zq GROUP BY ALL) USING (t, sid)),
comp AS (SELECT *, (0.45 * coalesce(fund_z, 0) + 0.30 * coalesce(mom_z, 0) + 0.25 * coalesce(qual_z, 0)) / nullif(CASE WHEN fund_z IS NOT NULL THEN 0.45 ELSE 0 END + CASE WHEN mom_z IS NOT NULL THEN 0.30 ELSE 0 END + CASE WHEN qual_z IS NOT NULL THEN 0.25 ELSE 0 END, 0) AS score FROM pil)
"""


def pillars(t):
    if "_pillars" not in t.__dict__:
        t.__dict__["_pillars"] = cut_lineage(N.pillar_scores(panel(t)))
    return t.__dict__["_pillars"]


@query("pillar_scores", "t:t sid:i fund_z:4 mom_z:4 qual_z:4", PILLAR_SQL + "SELECT * FROM pil")
def _(t):
    return pillars(t)


@query("composite", "t:t sid:i score:4", PILLAR_SQL + "SELECT * FROM comp")
def _(t):
    return N.composite(pillars(t))


MV_SQL = PANEL_SQL + "," + sql_global("zv", sql_rows({"EY": 1, "BP": 1, "MOM": 1})) + """,
mv AS (SELECT p.t, p.sid, 0.5 * m + 0.5 * v AS score FROM panel p LEFT JOIN (SELECT t, sid, avg(z) FILTER (factor <> 'MOM') AS v, max(z) FILTER (factor = 'MOM') AS m FROM zv GROUP BY ALL) USING (t, sid))
"""


@query("mom_value", "t:t sid:i score:4", MV_SQL + "SELECT * FROM mv")
def _(t):
    return N.mom_value(panel(t))


def sql_portfolio(weights, keys="leg"):
    """Gross, cost and turnover from (keys, t, sid, w, fwd) rows; drift is found through the next date."""
    k = keys.split(", ")
    on = " AND ".join(f"a.{c} = b.{c}" for c in k)
    return f"""
wt AS ({weights}),
dts AS (SELECT {keys}, t, lead(t) OVER (PARTITION BY {keys} ORDER BY t) AS nx FROM (SELECT DISTINCT {keys}, t FROM wt)),
dr AS (SELECT wt.*, w * (1 + coalesce(fwd, 0)) AS grown, sum(w * (1 + coalesce(fwd, 0))) OVER (PARTITION BY {keys}, t) AS tot FROM wt),
pv AS (SELECT {", ".join("dr." + c for c in k)}, dts.nx AS t, dr.sid, CASE WHEN tot > 0 THEN grown / tot ELSE w END AS w FROM dr JOIN dts USING ({keys}, t) WHERE dts.nx IS NOT NULL),
mv_ AS (SELECT {", ".join(f"coalesce(a.{c}, b.{c}) AS {c}" for c in k)}, coalesce(a.t, b.t) AS t, coalesce(a.sid, b.sid) AS sid, abs(coalesce(a.w, 0) - coalesce(b.w, 0)) AS d
  FROM wt a FULL JOIN pv b ON {on} AND a.t = b.t AND a.sid = b.sid),
cs AS (SELECT {", ".join("m." + c for c in k)}, m.t, sum(d * coalesce(CASE WHEN p.sid IS NOT NULL THEN 0.0013 * greatest(1, least(5, sqrt(50000000 / greatest(coalesce(p.adv30, 50000000), 1)))) END, 0.0013)) AS cost, sum(d) / 2 AS turnover
  FROM mv_ m LEFT JOIN panel p ON p.t = m.t AND p.sid = m.sid GROUP BY ALL),
pf AS (SELECT {", ".join("wt." + c for c in k)}, wt.t, sum(w * coalesce(fwd, 0)) AS gross, count(*) AS n, max(cost) AS cost, max(turnover) AS turnover, sum(w * coalesce(fwd, 0)) - max(cost) AS net
  FROM wt JOIN cs USING ({keys}, t) GROUP BY ALL)"""


QUINT_W = """SELECT 'Q' || b AS leg, t, sid, 1 / count(*) OVER (PARTITION BY t, b) AS w, fwd FROM (
  SELECT *, CAST(greatest(1, ceil(5 * (row_number() OVER (PARTITION BY t ORDER BY score, sid) - 1) / (count(*) OVER (PARTITION BY t) - 1))) AS INT) AS b, count(*) OVER (PARTITION BY t) AS n FROM {src} WHERE score IS NOT NULL)
  WHERE n >= 15 AND b IN (1, 5)"""
QUINT_SQL = PILLAR_SQL + "," + sql_portfolio(QUINT_W.format(src="comp"))


def quintile_portfolio(t):
    p = panel(t)
    legs = N.quintile_legs(N.composite(pillars(t)).select("t", "sid", "score"), p, [])
    return W.rebalanced_returns(legs, N.costs(p), ["leg"])


@query("quintile_portfolios", "leg:s t:t n:i gross:4 cost:6 net:4 turnover:5", QUINT_SQL + "SELECT * FROM pf")
def _(t):
    return quintile_portfolio(t)


@query("join_full_outer_holdings", "leg:s t:t turnover:5", QUINT_SQL + "SELECT * FROM pf")
def _(t):
    return quintile_portfolio(t)


def top_names(t, scores, n=5):
    """Top names by score of those that pass the study's filters."""
    ok = scaled(panel(t)).filter(N.study_filter()).select("t", "sid")
    return L.top_n(scores.filter("score is not null").join(ok, ["t", "sid"], "left_semi"), ["t"], "score", n)


def top_portfolio(t, scores, n=5):
    """Filtered top names at inverse volatility under the study's bounds."""
    p = panel(t)
    top = top_names(t, scores, n).join(p.select("t", "sid", "vol126", "fwd"), ["t", "sid"])
    w = W.inverse_vol_weights(top, ["t"], "vol126", "study").join(top.select("t", "sid", "fwd"), ["t", "sid"]).withColumn("leg", F.lit("TOP"))
    return W.rebalanced_returns(w, N.costs(p), ["leg"])


TOP_SQL = PILLAR_SQL + "," + FILTER_SQL[len(PANEL_SQL) + 1:].strip() + """,
tp AS (SELECT comp.t, comp.sid, comp.fwd, 1 / greatest(coalesce(comp.vol126, 0.3), 0.1) AS iv FROM comp JOIN ok USING (t, sid) WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY comp.t ORDER BY score DESC, comp.sid) <= 5),
w0 AS (SELECT t, sid, fwd, iv / sum(iv) OVER (PARTITION BY t) AS w, 0 AS it, false AS done FROM tp),
it AS (SELECT * FROM w0 UNION ALL
  SELECT t, sid, fwd, CASE WHEN done THEN w ELSE nw END, it + 1, done OR (max(nw) OVER (PARTITION BY t) <= 0.3 + 1e-9 AND min(nw) OVER (PARTITION BY t) >= 0.05 - 1e-9) FROM (
    SELECT *, greatest(0.05, least(0.3, w)) / sum(greatest(0.05, least(0.3, w))) OVER (PARTITION BY t) AS nw FROM it WHERE it < 20)),
""" + sql_portfolio("SELECT 'TOP' AS leg, t, sid, w, fwd FROM it WHERE it = 20")
TOP_SQL = TOP_SQL.replace("WITH reb", "WITH RECURSIVE reb", 1)


@query("top_portfolios", "leg:s t:t n:i gross:4 net:4 turnover:5", TOP_SQL + "SELECT * FROM pf")
def _(t):
    return top_portfolio(t, N.composite(pillars(t)).select("t", "sid", "score"))


@query("allocation_premium", "date:t i:i erp:6 sleeve:s w:6", TOP_SQL + f""",
ap_ds AS ({MIX_SQL} SELECT reg.date, reg.sno - 1 AS i, regime, tsmom FROM reg JOIN tm USING (date)),
ap_ey AS (SELECT tp.t, avg(EY * 20) AS ey FROM tp JOIN panel p ON p.t = tp.t AND p.sid = tp.sid GROUP BY tp.t),
ap_er AS (SELECT d.*, cdi FROM ap_ds d JOIN cdi USING (date) WHERE d.i % 21 = 0),
ap_pr AS (SELECT ap_er.*, ap_ey.ey - (pow(1 + cdi, 252) - 1) AS erp FROM ap_er ASOF LEFT JOIN ap_ey ON ap_er.date >= ap_ey.t),
ap_b1 AS (SELECT *, CASE regime WHEN 'risk_on' THEN 0.6 WHEN 'bear' THEN 0.2 ELSE 0.4 END AS be, CASE regime WHEN 'risk_on' THEN 0.15 WHEN 'bear' THEN 0.5 ELSE 0.3 END AS bc, CASE regime WHEN 'risk_on' THEN 0.10 ELSE 0.15 END AS bi,
  CASE WHEN tsmom > 0 THEN 0.1 WHEN tsmom <= 0 THEN -0.1 ELSE 0 END + CASE WHEN erp < 0.02 THEN -0.1 WHEN erp > 0.08 THEN 0.1 ELSE 0 END AS tilt FROM ap_pr),
ap_b2 AS (SELECT *, greatest(0.1, least(0.7, be + tilt)) AS e FROM ap_b1), ap_b3 AS (SELECT *, greatest(bc - (e - be), 0) AS c FROM ap_b2)
SELECT date, i, erp, unnest(['equities_br', 'cdi', 'global_usd', 'inflation']) AS sleeve, unnest([e / (e + c + 0.15 + bi), c / (e + c + 0.15 + bi), 0.15 / (e + c + 0.15 + bi), bi / (e + c + 0.15 + bi)]) AS w FROM ap_b3""")
def _(t):
    # the tables' earnings are small against their market values; times 20 they fall on all sides of the thresholds
    basket = top_names(t, N.composite(pillars(t)).select("t", "sid", "score")).join(panel(t).select("t", "sid", (F.col("EY") * 20).alias("ey")), ["t", "sid"])
    erp = W.implied_premium(basket, t.cdi)
    days = index_regime(t).select("date", "regime").join(W.tsmom_excess(t.index_close, t.cdi.select("date", "cdi")), "date").withColumn("i", F.col("sno") - 1).filter("i % 21 = 0").join(erp, "date")
    return W.mix_to_rows(days.select("date", "i", "erp", "regime", "tsmom"), W.dynamic_mix(F.col("regime"), F.col("erp"), F.col("tsmom")))


@query("score_fn", "leg:s t:t n:i gross:4 net:4 turnover:5", MV_SQL + "," + sql_portfolio(QUINT_W.format(src="(SELECT mv.*, p.fwd FROM mv JOIN panel p USING (t, sid))")) + " SELECT * FROM pf")
def _(t):
    # any function of the panel that returns (t, sid, score) plugs into the portfolios
    p = panel(t)
    scores = p.transform(N.mom_value)
    return W.rebalanced_returns(N.quintile_legs(scores, p, []), N.costs(p), ["leg"])


#: Two rules as a user would write them: standardised by month through one aggregate, and a plain formula.
MOMENTUM_RULE = """
WITH m AS (SELECT t, avg(MOM) AS mm, stddev_samp(MOM) AS ms, avg(EY) AS em, stddev_samp(EY) AS es FROM rule_panel GROUP BY t)
SELECT p.t, p.sid, momentum * (p.MOM - mm) / nullif(ms, 0) + (1 - momentum) * (p.EY - em) / nullif(es, 0) FROM rule_panel p JOIN m ON p.t = m.t"""
CALM_RULE = "SELECT t, sid, EY - penalty * vol126 FROM rule_panel"
RULE_W = """SELECT rule, 'Q' || b AS leg, t, sid, 1 / count(*) OVER (PARTITION BY rule, t, b) AS w, fwd FROM (
  SELECT *, CAST(greatest(1, ceil(5 * (row_number() OVER (PARTITION BY rule, t ORDER BY score, sid) - 1) / nullif(count(*) OVER (PARTITION BY rule, t) - 1, 0))) AS INT) AS b, count(*) OVER (PARTITION BY rule, t) AS n FROM rs WHERE score IS NOT NULL)
  WHERE n >= 15 AND b IN (1, 5)"""


@query("score_rule_functions", "rule:s leg:s t:t n:i gross:4 net:4 turnover:5", PANEL_SQL + """,
mo AS (SELECT t, avg(MOM) AS mm, stddev_samp(MOM) AS ms, avg(EY) AS em, stddev_samp(EY) AS es FROM panel GROUP BY t),
rs AS (SELECT 'momentum' AS rule, p.t, p.sid, round(0.7::DOUBLE * (MOM - mm) / nullif(ms, 0) + 0.3::DOUBLE * (EY - em) / nullif(es, 0), 9) AS score, fwd FROM panel p JOIN mo ON p.t = mo.t
  UNION ALL SELECT 'calm', t, sid, round(EY - 0.1::DOUBLE * vol126, 9), fwd FROM panel),
""" + sql_portfolio(RULE_W, "rule, leg") + " SELECT * FROM pf")
def _(t):
    p = panel(t)
    momentum = U.score_rule(p, "momentum_score", MOMENTUM_RULE, "momentum DOUBLE DEFAULT 0.5")
    calm = U.score_rule(p, "calm_score", CALM_RULE, "penalty DOUBLE")
    scores = p.transform(momentum, 0.7).withColumn("rule", F.lit("momentum")).unionByName(p.transform(calm, 0.1).withColumn("rule", F.lit("calm")))
    scores = scores.withColumn("score", F.round("score", 9))  # last bits of a sum must not decide a rank
    return W.rebalanced_returns(N.quintile_legs(scores, p, ["rule"]), N.costs(p), ["rule", "leg"])
