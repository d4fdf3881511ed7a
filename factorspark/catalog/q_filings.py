"""Company filing queries."""

from pyspark.sql import functions as F

from factorspark.catalog.registry import query
from factorspark.operators import filings as G
from factorspark.operators import timeseries as ts

NORM = "lower(strip_accents(ds))"
LINES_SQL = f"""
WITH n AS (SELECT * REPLACE (CASE WHEN ordem = 'PENÚLTIMO' THEN 'prev' ELSE 'cur' END AS ordem, {NORM} AS ds),
             length(code) - length(replace(code, '.', '')) AS depth FROM statement_lines),
scoped AS (SELECT * FROM n WHERE scope = 'con' OR NOT EXISTS (SELECT 1 FROM n m WHERE m.scope = 'con' AND m.issuer = n.issuer AND m.dt_refer = n.dt_refer AND m.sheet = n.sheet)),
fl AS (SELECT * FROM scoped WHERE sheet IN ('DRE', 'DFC') QUALIFY ini = min(ini) OVER (PARTITION BY issuer, dt_refer, sheet, ordem)),
dre AS (SELECT *, min(CASE WHEN regexp_matches(ds, '{G.NET_INCOME}') THEN code END) OVER (PARTITION BY issuer, dt_refer, ordem) AS ni FROM fl WHERE sheet = 'DRE'),
inc AS (SELECT issuer, dt_refer, ordem,
  arg_min(value, ds) FILTER (code = '3.01') AS revenue, arg_min(value, code) FILTER (ds LIKE '%resultado bruto%' AND depth = 1) AS gross_profit,
  arg_min(value, code) FILTER (ds LIKE 'resultado antes do resultado financeiro%' AND depth = 1) AS ebit,
  arg_min(value, code) FILTER (ds LIKE 'resultado antes dos tributos%' AND depth = 1) AS pretax_income,
  arg_min(value, code) FILTER (regexp_matches(ds, '{G.NET_INCOME}') AND depth = 1) AS net_income,
  arg_min(value, code) FILTER (starts_with(code, ni || '.') AND depth <= 2 AND ds LIKE '%controladora%') AS ctrl
  FROM dre GROUP BY ALL),
dfc AS (SELECT * FROM fl WHERE sheet = 'DFC'),
cx AS (SELECT * FROM dfc WHERE starts_with(code, '6.02.') AND regexp_matches(ds, '{G.CAPEX}') AND NOT regexp_matches(ds, '{G.NOT_CAPEX}') AND value < 0),
cxl AS (SELECT * FROM cx WHERE NOT EXISTS (SELECT 1 FROM cx o WHERE o.issuer = cx.issuer AND o.dt_refer = cx.dt_refer AND o.ordem = cx.ordem AND starts_with(o.code, cx.code || '.'))),
dn AS (SELECT * FROM dfc WHERE starts_with(code, '6.01.01.') AND regexp_matches(ds, '{G.DEPRECIATION}')),
dnl AS (SELECT * FROM dn WHERE NOT EXISTS (SELECT 1 FROM dn o WHERE o.issuer = dn.issuer AND o.dt_refer = dn.dt_refer AND o.ordem = dn.ordem AND starts_with(o.code, dn.code || '.'))),
pk AS (SELECT issuer, dt_refer, ordem, 'o' AS f, value FROM dfc WHERE code = '6.01' UNION ALL SELECT issuer, dt_refer, ordem, 'x', value FROM cxl UNION ALL SELECT issuer, dt_refer, ordem, 'd', value FROM dnl),
csh AS (SELECT issuer, dt_refer, ordem, max(value) FILTER (f = 'o') AS operating_cash_flow, sum(value) FILTER (f = 'x') AS capex, sum(value) FILTER (f = 'd') AS dna FROM pk GROUP BY ALL),
flows AS (SELECT issuer, dt_refer, ordem, revenue, gross_profit, ebit, pretax_income, net_income, coalesce(ctrl, net_income) AS net_income_controlling, operating_cash_flow, capex, dna
  FROM (SELECT DISTINCT issuer, dt_refer, ordem FROM fl) LEFT JOIN inc USING (issuer, dt_refer, ordem) LEFT JOIN csh USING (issuer, dt_refer, ordem)),
bal AS (SELECT *, min(CASE WHEN sheet = 'BPP' AND ds LIKE '%patrimonio liquido%' THEN code END) OVER (PARTITION BY issuer, dt_refer) AS eq FROM scoped WHERE ordem = 'cur' AND sheet IN ('BPA', 'BPP')),
st0 AS (SELECT issuer, dt_refer, arg_min(value, ini) FILTER (code = '1') AS x, arg_min(value, code) FILTER (code = '1') AS total_assets,
  arg_min(value, code) FILTER (ds LIKE 'caixa e equivalentes%') AS cash, arg_min(value, code) FILTER (ds LIKE 'aplicacoes financeiras%') AS short_term_investments,
  arg_min(value, code) FILTER (code = '2.03') AS equity, arg_min(value, code) FILTER (code = '2.03.09' AND eq IS NOT NULL AND eq = '2.03') AS nci,
  sum(value) FILTER (code IN ('2.01.04', '2.02.01')) AS gross_debt FROM bal GROUP BY ALL),
stocks AS (SELECT issuer, dt_refer, total_assets, cash, short_term_investments, equity, equity - coalesce(nci, 0) AS equity_controlling, gross_debt FROM st0),
flags AS (SELECT issuer, dt_refer, bool_or(code = '3.01' AND ds LIKE '%intermediacao financeira%') AS is_bank, bool_or(depth <= 1 AND ds LIKE '%premios%') AS is_insurer FROM scoped WHERE sheet = 'DRE' GROUP BY ALL)
"""
FORM = "CASE WHEN month(dt_refer) = 12 THEN 'DFP' ELSE 'ITR' END"
Y = ", ".join(f"c.{f} AS {f}_ytd" if f not in ("capex", "dna") else f"CASE WHEN NOT coalesce(is_bank, false) THEN c.{f} END AS {f}_ytd" for f in G.FLOWS)
YP = ", ".join(f"p.{f} AS {f}_ytd_prev" if f not in ("capex", "dna") else f"CASE WHEN NOT coalesce(is_bank, false) THEN p.{f} END AS {f}_ytd_prev" for f in G.FLOWS)
DOCS_SQL = LINES_SQL + f""",
sp AS (SELECT issuer, dt_refer, min(ini) AS fy_start FROM fl WHERE ordem = 'cur' GROUP BY ALL),
docs AS (SELECT d.issuer, d.dt_refer, {FORM} AS form, fy_start, CAST(round((d.dt_refer - fy_start) / 30.44) AS INT) AS ytd_months, {Y}, {YP},
  total_assets, cash, short_term_investments, equity, equity_controlling, gross_debt, coalesce(is_bank, false) AS is_bank, coalesce(is_insurer, false) AS is_insurer
  FROM (SELECT DISTINCT issuer, dt_refer FROM scoped) d LEFT JOIN (SELECT * FROM flows WHERE ordem = 'cur') c USING (issuer, dt_refer)
  LEFT JOIN (SELECT * FROM flows WHERE ordem = 'prev') p USING (issuer, dt_refer) LEFT JOIN stocks USING (issuer, dt_refer) LEFT JOIN flags USING (issuer, dt_refer) LEFT JOIN sp USING (issuer, dt_refer)),
ver AS (SELECT o_custkey // 10 AS issuer, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS dt_refer,
  last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) + CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 90 AS INTEGER) END AS received, o_orderkey AS version FROM orders),
av AS (SELECT issuer, dt_refer, min(received) AS available_from, max(received) AS last_received, count(DISTINCT version) FILTER (received IS NOT NULL) AS n_versions FROM ver GROUP BY ALL HAVING min(received) IS NOT NULL),
pit AS (SELECT * FROM docs JOIN av USING (issuer, dt_refer)),
ann AS (SELECT * FROM pit WHERE form = 'DFP'),
ttm AS (SELECT p.*, {", ".join(f"CASE WHEN p.form = 'DFP' OR coalesce(p.ytd_months, 0) = 12 THEN p.{f}_ytd ELSE p.{f}_ytd + a.{f}_ytd - p.{f}_ytd_prev END AS {f}_ttm" for f in G.FLOWS)}
  FROM pit p LEFT JOIN ann a ON a.issuer = p.issuer AND a.dt_refer = p.fy_start - 1)
"""


def scoped(t):
    return G.pick_scope(G.normalize_lines(t.statement_lines))


def flow_lines(t):
    return G.ytd_lines(scoped(t).filter("sheet in ('DRE', 'DFC')"))


def form():
    return F.when(F.month("dt_refer") == 12, "DFP").otherwise("ITR")


def docs(t):
    return G.documents(t.statement_lines, form())


def versions(t):
    ref = F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2))
    days = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey") % 90)  # the others are announced and not yet received
    return t.raw("orders").select(
        F.floor(F.col("o_custkey") / 10).alias("issuer"), ref.alias("dt_refer"),
        F.when(F.month(ref) == 12, "DFP").otherwise("ITR").alias("form"),
        F.date_add(ref, days.cast("int")).alias("received"), F.col("o_orderkey").alias("version"))


def pit(t):
    return G.availability(docs(t), versions(t))


KEY = "issuer:i dt_refer:t"


@query("join_scope_preference", f"{KEY} sheet:s scope:s ordem:s code:s ini:t value:2 ds:s", LINES_SQL + "SELECT * FROM scoped")
def _(t):
    return scoped(t)


@query("agg_ytd_rows", f"{KEY} sheet:s ordem:s code:s ds:s ini:t value:2", LINES_SQL + "SELECT * FROM fl")
def _(t):
    return flow_lines(t)


@query("agg_first_account", f"{KEY} ordem:s gross_profit:2 ebit:2", LINES_SQL + "SELECT * FROM flows WHERE gross_profit IS NOT NULL OR ebit IS NOT NULL")
def _(t):
    ds, depth = F.col("ds"), G.code_depth(F.col("code"))
    return (flow_lines(t).filter("sheet = 'DRE'").groupBy("issuer", "dt_refer", "ordem").agg(
        G.first_account(ds.rlike("resultado bruto") & (depth == 1)).alias("gross_profit"),
        G.first_account(ds.rlike("^resultado antes do resultado financeiro") & (depth == 1)).alias("ebit"))
        .filter("gross_profit is not null or ebit is not null"))


@query("agg_flows", f"{KEY} ordem:s " + " ".join(f"{f}:2" for f in G.FLOWS), LINES_SQL + "SELECT * FROM flows")
def _(t):
    return G.flows(scoped(t))


STOCK_COLS = "total_assets:2 cash:2 short_term_investments:2 equity:2 equity_controlling:2 gross_debt:2"
# lines of one code may start at two dates; the balance queries read one row per code
ONE_INI = "(SELECT issuer, dt_refer, sheet, scope, ordem, min(ini) AS ini, code, ds, round(sum(value), 2) AS value FROM statement_lines GROUP BY ALL)"
BAL_SQL = LINES_SQL.replace("FROM statement_lines", f"FROM {ONE_INI}")
BAL_DOCS_SQL = DOCS_SQL.replace("FROM statement_lines", f"FROM {ONE_INI}")


def one_ini(t):
    return t.statement_lines.groupBy("issuer", "dt_refer", "sheet", "scope", "ordem", "code", "ds").agg(
        F.min("ini").alias("ini"), F.round(F.sum("value"), 2).alias("value"))


@query("agg_stocks", f"{KEY} {STOCK_COLS}", BAL_SQL + "SELECT * FROM stocks")
def _(t):
    return G.stocks(G.pick_scope(G.normalize_lines(one_ini(t))))


@query("agg_issuer_flags", f"{KEY} is_bank:b is_insurer:b", LINES_SQL + "SELECT * FROM flags")
def _(t):
    return G.issuer_flags(scoped(t))


@query("agg_document", f"{KEY} form:s fy_start:t ytd_months:i is_bank:b " + " ".join(f"{f}_ytd:2 {f}_ytd_prev:2" for f in G.FLOWS) + " " + STOCK_COLS,
       BAL_DOCS_SQL + "SELECT * FROM docs")
def _(t):
    return G.documents(one_ini(t), form())


@query("anti_leaf_only", f"{KEY} ordem:s code:s value:2", LINES_SQL + "SELECT * FROM dnl")
def _(t):
    dna = flow_lines(t).filter(F.col("code").startswith("6.01.01.") & F.col("ds").rlike(G.DEPRECIATION) & (F.col("sheet") == "DFC"))
    return G.leaves(dna, ["issuer", "dt_refer", "ordem"])


@query("join_parent_child", f"{KEY} ordem:s code:s child_code:s value:2 child_value:2", LINES_SQL + """
SELECT a.issuer, a.dt_refer, a.ordem, a.code, b.code AS child_code, a.value, b.value AS child_value
FROM fl a JOIN fl b ON a.issuer = b.issuer AND a.dt_refer = b.dt_refer AND a.ordem = b.ordem AND starts_with(b.code, a.code || '.')""")
def _(t):
    return G.parent_child(flow_lines(t), ["issuer", "dt_refer", "ordem"])


@query("agg_versions", f"{KEY} available_from:t last_received:t n_versions:i form:s", DOCS_SQL + "SELECT * FROM pit")
def _(t):
    return pit(t)


@query("ttm", f"{KEY} form:s " + " ".join(f"{f}_ttm:2" for f in G.FLOWS), BAL_DOCS_SQL + "SELECT * FROM ttm")
def _(t):
    return G.add_ttm(G.availability(G.documents(one_ini(t), form()), versions(t)))


@query("join_self_prior_fy", f"{KEY} form:s revenue_ytd:2 revenue_ttm:2", BAL_DOCS_SQL + "SELECT * FROM ttm")
def _(t):
    return G.add_ttm(G.availability(G.documents(one_ini(t), form()), versions(t)), ("revenue",))


@query("pit_fundamentals", f"{KEY} available_from:t n_versions:i revenue_ttm:2 net_income_ttm:2 total_assets:2 equity_controlling:2 gross_debt:2",
       BAL_DOCS_SQL + "SELECT * FROM ttm")
def _(t):
    return G.add_ttm(G.availability(G.documents(one_ini(t), form()), versions(t)))


MONTHS = "(SELECT max(date) AS t FROM sessions GROUP BY date_trunc('month', date))"
ASOF_SQL = f"""
WITH p AS (SELECT issuer, t AS as_of FROM (SELECT DISTINCT issuer FROM filings), {MONTHS}),
j AS (SELECT p.issuer, p.as_of, f.dt_refer, f.available_from, f.value, f.form, row_number() OVER (PARTITION BY p.issuer, p.as_of ORDER BY f.dt_refer DESC, f.available_from DESC) AS r
      FROM p JOIN filings f ON f.issuer = p.issuer AND f.available_from <= p.as_of AND p.as_of - f.dt_refer <= 500)
"""


def probes(t):
    months = ts.month_ends(t.sessions).agg(F.collect_list("t").alias("d"))
    return t.filings.select("issuer").distinct().join(F.broadcast(months)).select("issuer", F.explode("d").alias("as_of"))


@query("join_asof_pit", "issuer:i as_of:t dt_refer:t available_from:t value:2", ASOF_SQL + "SELECT * FROM j WHERE r = 1")
def _(t):
    return G.as_of(probes(t), t.filings, ["value"])


SHARES_SQL = f"""
WITH d AS (SELECT issuer, dt_refer, available_from, CASE WHEN issuer % 4 = 0 AND month(dt_refer) <> 6 THEN value END AS sh FROM filings),
p AS (SELECT issuer, t AS as_of FROM (SELECT DISTINCT issuer FROM filings), {MONTHS}),
a AS (SELECT p.*, d.dt_refer, d.sh, 'ITR/DFP' AS source FROM p JOIN d ON d.issuer = p.issuer AND d.available_from <= p.as_of AND d.sh IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY p.issuer, p.as_of ORDER BY d.dt_refer DESC, d.available_from DESC) = 1),
f AS (SELECT issuer, dt_refer, available_from + 30 AS available_from, value * 2 AS sh FROM filings WHERE form = 'DFP'),
b AS (SELECT p.*, f.dt_refer, f.sh, 'FRE' AS source FROM p JOIN f ON f.issuer = p.issuer AND f.available_from <= p.as_of
      WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.issuer = p.issuer AND a.as_of = p.as_of)
      QUALIFY row_number() OVER (PARTITION BY p.issuer, p.as_of ORDER BY f.dt_refer DESC, f.available_from DESC) = 1)
SELECT issuer, as_of, dt_refer, sh AS shares_total, source FROM a UNION ALL SELECT issuer, as_of, dt_refer, sh, source FROM b"""


@query("join_asof_shares", "issuer:i as_of:t dt_refer:t shares_total:2 source:s", SHARES_SQL)
def _(t):
    own = F.when((F.col("issuer") % 4 == 0) & (F.month("dt_refer") != 6), F.col("value"))
    d = t.filings.withColumn("shares_total", own)
    fre = (t.filings.filter("form = 'DFP'").withColumn("available_from", F.date_add("available_from", 30))
           .withColumn("shares_total", F.col("value") * 2))
    return G.shares_as_of(probes(t), d, fre, ["shares_total"])


SCALE_SQL = """
WITH d AS (SELECT issuer, dt_refer, value AS equity_controlling, CASE WHEN issuer % 5 <> 0 THEN value / CASE WHEN issuer % 3 = 0 THEN 5000 ELSE 3 END END AS shares_total FROM filings),
f AS (SELECT issuer, year(dt_refer) AS y, CASE WHEN issuer % 2 = 0 THEN value * 0.2::DOUBLE END AS fre_total FROM filings WHERE form = 'DFP'),
j AS (SELECT d.*, fre_total, coalesce(fre_total / shares_total BETWEEN 300 AND 3000, false) AS by_fre,
  fre_total IS NULL AND coalesce(equity_controlling / shares_total > 1000, false) AS by_book FROM d LEFT JOIN f ON f.issuer = d.issuer AND f.y = year(d.dt_refer))
SELECT issuer, dt_refer, CASE WHEN shares_total IS NOT NULL THEN CASE WHEN by_fre OR by_book THEN 1000 ELSE 1 END END AS shares_scale,
 CASE WHEN by_fre THEN 'fre' WHEN by_book THEN 'bvps' END AS scale_source, shares_total * CASE WHEN by_fre OR by_book THEN 1000 ELSE 1 END AS shares_total FROM j"""


@query("fix_unit_scale", f"{KEY} shares_scale:1 scale_source:s shares_total:5", SCALE_SQL)
def _(t):
    div = F.when(F.col("issuer") % 3 == 0, 5000).otherwise(3)
    d = t.filings.select("issuer", "dt_refer", F.col("value").alias("equity_controlling"),
                         F.when(F.col("issuer") % 5 != 0, F.col("value") / div).alias("shares_total"))
    fre = t.filings.filter("form = 'DFP'").select("issuer", "dt_refer", F.when(F.col("issuer") % 2 == 0, F.col("value") * 0.2).alias("shares_total"))
    return G.fix_share_scale(d, fre)


@query("agg_latest_shares", f"{KEY} version:i value:2", """
SELECT issuer, dt_refer, max(version) AS version, arg_max(value, version) AS value FROM order_docs GROUP BY ALL""")
def _(t):
    return G.latest_version(t.order_docs.withColumn("v", F.col("version")), ["issuer", "dt_refer"], "v", ["version", "value"])


@query("agg_fre_shares", f"{KEY} received:t value:2", """
SELECT issuer, dt_refer, received, value FROM order_docs QUALIFY row_number() OVER (PARTITION BY issuer, dt_refer ORDER BY received DESC, version DESC) = 1""")
def _(t):
    rows = t.order_docs.withColumn("o", F.struct("received", "version"))
    return G.latest_version(rows, ["issuer", "dt_refer"], "o", ["received", "value"])


@query("agg_sector_by_year", "issuer:i year:i segment:s", """
SELECT o_custkey AS issuer, year(o_orderdate) AS year, arg_max(o_orderpriority, o_orderkey) AS segment FROM orders GROUP BY ALL""")
def _(t):
    return t.raw("orders").groupBy(F.col("o_custkey").alias("issuer"), F.year("o_orderdate").alias("year")).agg(
        F.max_by("o_orderpriority", "o_orderkey").alias("segment"))


@query("agg_ticker_map", "issuer:i ticker:s name:s first_year:i last_year:i start:t finish:t", """
SELECT issuer, form AS ticker, arg_max('n' || version, version) AS name, min(year(dt_refer)) AS first_year, max(year(dt_refer)) AS last_year,
 min(received) AS start, max(received) AS finish FROM order_docs GROUP BY ALL""")
def _(t):
    return t.order_docs.groupBy("issuer", F.col("form").alias("ticker")).agg(
        F.max_by(F.concat(F.lit("n"), F.col("version").cast("string")), "version").alias("name"), F.min(F.year("dt_refer")).alias("first_year"),
        F.max(F.year("dt_refer")).alias("last_year"), F.min("received").alias("start"), F.max("received").alias("finish"))


ISSUERS_SQL = """
WITH tk AS (SELECT root, min(sid) AS code FROM securities GROUP BY root), rg AS (SELECT root, min(sid) + 1000 AS code FROM securities WHERE sid % 3 = 0 GROUP BY root),
mn AS (SELECT root, min(sid) + 9000 AS code FROM securities WHERE sid % 14 = 0 GROUP BY root),
b AS (SELECT root, coalesce(mn.code, rg.code, tk.code) AS code FROM tk LEFT JOIN rg USING (root) LEFT JOIN mn USING (root)),
sc AS (SELECT DISTINCT 'X' || root AS root, root AS heir FROM securities WHERE sid % 5 = 0)
SELECT root, code FROM b UNION ALL SELECT sc.root, b.code FROM sc JOIN b ON b.root = sc.heir"""


def issuers(t):
    s = t.securities
    tk = s.groupBy("root").agg(F.min("sid").alias("code"))
    rg = s.filter("sid % 3 = 0").groupBy("root").agg((F.min("sid") + 1000).alias("code"))
    mn = s.filter("sid % 14 = 0").groupBy("root").agg((F.min("sid") + 9000).alias("code"))
    sc = s.filter("sid % 5 = 0").select(F.concat(F.lit("X"), "root").alias("root"), F.col("root").alias("heir")).distinct()
    return G.issuer_map(tk, rg, mn, sc)


@query("issuer_map", "root:s code:i", ISSUERS_SQL)
def _(t):
    return issuers(t)


@query("join_self_prior_year", f"{KEY} value:2 growth:6", """
SELECT a.issuer, a.dt_refer, a.value, a.value / b.value - 1 AS growth FROM filings a LEFT JOIN filings b ON b.issuer = a.issuer AND b.dt_refer = last_day(a.dt_refer - INTERVAL 12 MONTH)""")
def _(t):
    base = t.filings.select("issuer", F.last_day(F.add_months("dt_refer", 12)).alias("dt_refer"), F.col("value").alias("base"))
    return t.filings.join(base, ["issuer", "dt_refer"], "left").withColumn("growth", F.col("value") / F.when(F.col("base") > 0, F.col("base")) - 1)


@query("join_equi_left", f"{KEY} available_from:t shares_value:2", """
SELECT f.issuer, f.dt_refer, f.available_from, s.value AS shares_value FROM filings f
LEFT JOIN (SELECT issuer, dt_refer, max(value) AS value FROM order_docs GROUP BY ALL) s USING (issuer, dt_refer)""")
def _(t):
    s = t.order_docs.groupBy("issuer", "dt_refer").agg(F.max("value").alias("shares_value"))
    return t.filings.join(s, ["issuer", "dt_refer"], "left")


CAP_SQL = """
WITH px AS (SELECT date, root, max(close) FILTER (cls = '3') AS p_on, max(close) FILTER (cls = '4') AS p_pn FROM spec_bars GROUP BY ALL),
sp AS (SELECT DISTINCT sid, last_date_prior, multiplier FROM stock_events),
r AS (SELECT b.sid, b.date, b.root, (b.sid * 7 % 90) * 1000.0 + 500 AS sh_on, CASE WHEN b.sid % 3 <> 0 THEN (b.sid * 11 % 80) * 500.0 END AS sh_pn,
        CASE WHEN b.sid % 8 <> 0 THEN (b.sid * 13 % 170) * 900.0 + 800 END AS sh_total, b.date - 150 AS doc_ref FROM spec_bars b),
s AS (SELECT r.sid, r.date, product(multiplier) AS split FROM r JOIN sp ON sp.sid = r.sid AND sp.last_date_prior > r.doc_ref AND sp.last_date_prior <= r.date GROUP BY ALL),
mc AS (SELECT r.*, p_on, p_pn, coalesce(split, 1) AS split,
 CASE WHEN sh_total IS NOT NULL THEN CASE WHEN p_on IS NOT NULL AND sh_on > 0 THEN sh_on * p_on + CASE WHEN sh_pn > 0 THEN sh_pn * coalesce(p_pn, p_on) ELSE 0 END
   WHEN p_pn IS NOT NULL THEN sh_total * p_pn END * coalesce(split, 1) END AS mcap
FROM r LEFT JOIN px USING (date, root) LEFT JOIN s USING (sid, date))
"""


def cap_rows(t):
    sid = F.col("sid")
    rows = t.spec_bars.select(
        "sid", "date", "root", ((sid * 7 % 90) * 1000.0 + 500).alias("sh_on"), F.when(sid % 3 != 0, (sid * 11 % 80) * 500.0).alias("sh_pn"),
        F.when(sid % 8 != 0, (sid * 13 % 170) * 900.0 + 800).alias("sh_total"), F.date_sub("date", 150).alias("doc_ref"))
    ev = t.stock_events.dropDuplicates(["sid", "last_date_prior", "multiplier"]).select("sid", F.col("last_date_prior").alias("date"), "multiplier")
    rows = G.split_between(ev, rows.withColumnRenamed("date", "tp"), "sid", "doc_ref", "tp").withColumnRenamed("tp", "date")
    px = G.class_prices(t.spec_bars.select("date", "root", "cls", "close"))
    return rows.join(px, ["date", "root"], "left").withColumn(
        "mcap", G.market_cap(F.col("sh_on"), F.col("sh_pn"), F.col("sh_total"), F.col("p_on"), F.col("p_pn"), F.col("split")))


@query("join_market_cap_price", "date:t root:s p_on:8 p_pn:8", CAP_SQL + "SELECT * FROM px")
def _(t):
    return G.class_prices(t.spec_bars.select("date", "root", "cls", "close"))


@query("agg_split_after_doc", "sid:i date:t split:6", CAP_SQL + "SELECT * FROM mc")
def _(t):
    return cap_rows(t)


@query("market_cap", "sid:i date:t mcap:5", CAP_SQL + "SELECT * FROM mc")
def _(t):
    return cap_rows(t)


@query("join_semi_members", "sid:i n:i", """
SELECT sid, count(*) AS n FROM bars WHERE sid IN (SELECT sid FROM securities WHERE sector = 'ASIA' OR acctbal > 5000) GROUP BY sid""")
def _(t):
    members = t.securities.filter("sector = 'ASIA' or acctbal > 5000").select("sid")
    return t.bars.join(members, "sid", "left_semi").groupBy("sid").agg(F.count("*").alias("n"))
