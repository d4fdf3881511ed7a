"""Price history queries."""

from pyspark.sql import functions as F

from factorspark.catalog.registry import query
from factorspark.operators import prices as P
from factorspark.operators import timeseries as ts

_RATIOS = ", ".join(repr(float(k)) for k in sorted(set(map(float, P.COMMON_RATIOS))))
_MARKER_RATIOS = ", ".join(repr(float(k)) for k in sorted(set(map(float, P.COMMON_RATIOS + P.BONUS_RATIOS))))

EVENTS_SQL = """
WITH c AS (
  SELECT DISTINCT s.sid, e.last_date_prior, e.value, e.label FROM cash_events e JOIN securities s ON s.root = e.root AND s.kind = e.type),
cx AS (SELECT c.sid, c.value, (SELECT min(b.date) FROM bars b WHERE b.sid = c.sid AND b.date > c.last_date_prior) AS date FROM c),
d AS (SELECT sid, date, sum(value) AS dividend FROM cx WHERE date IS NOT NULL GROUP BY ALL),
st AS (SELECT DISTINCT sid, last_date_prior, multiplier FROM stock_events),
sx AS (SELECT st.sid, st.multiplier, (SELECT min(b.date) FROM bars b WHERE b.sid = st.sid AND b.date > st.last_date_prior) AS date FROM st),
m AS (SELECT sid, date, product(multiplier) AS event_mult FROM sx WHERE date IS NOT NULL GROUP BY ALL)
"""

PASSES_SQL = EVENTS_SQL + f""",
b0 AS (
  SELECT b.sid, b.ticker, b.date, b.close, b.volume, b.trades, coalesce(d.dividend, 0) AS dividend, m.event_mult,
         lag(b.close) OVER w AS prev,
         CASE WHEN b.spec LIKE '% EB' THEN 'EB' WHEN b.spec LIKE '% ED' THEN 'ED' ELSE '' END AS marker
  FROM spec_bars b LEFT JOIN d USING (sid, date) LEFT JOIN m USING (sid, date)
  WINDOW w AS (PARTITION BY b.sid ORDER BY b.date)),
b1 AS (
  SELECT *, (close + dividend) / prev AS raw, lag(marker) OVER (PARTITION BY sid ORDER BY date) AS prev_marker FROM b0),
b2 AS (
  SELECT *, coalesce(raw IS NOT NULL AND abs(event_mult - 1) >= 1e-9, false) AS tested,
         coalesce(abs(ln(raw * event_mult)) <= 0.25, false) AS confirmed FROM b1),
b3 AS (SELECT *, CASE WHEN tested AND confirmed THEN event_mult ELSE 1.0 END AS m1 FROM b2),
b4 AS (
  SELECT *, max(CASE WHEN m1 <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near1,
         list_min([{{'gap': abs(ln(raw * k)), 'ratio': k}} FOR k IN [{_MARKER_RATIOS}]::DOUBLE[]]) AS n2 FROM b3),
b5 AS (
  SELECT *, (prev_marker IS NULL OR marker <> prev_marker) AND marker = 'EB' AND near1 = 0 AND raw IS NOT NULL AS try2 FROM b4),
b6 AS (SELECT *, try2 AND n2.gap < abs(ln(raw)) - 0.02 AND n2.gap <= 0.05 AS ok2 FROM b5),
b7 AS (SELECT *, m1 * CASE WHEN ok2 THEN n2.ratio ELSE 1.0 END AS m2 FROM b6),
b8 AS (
  SELECT *, max(CASE WHEN m2 <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near2,
         list_min([{{'gap': abs(ln(raw * k)), 'ratio': k}} FOR k IN [{_RATIOS}]::DOUBLE[]]) AS n3 FROM b7),
b9 AS (SELECT *, coalesce((raw < 0.6 OR raw > 1.6) AND near2 = 0 AND raw IS NOT NULL, false) AS try3 FROM b8),
b10 AS (SELECT *, try3 AND n3.gap <= 0.10 AS ok3 FROM b9),
passes AS (SELECT *, m2 * CASE WHEN ok3 THEN n3.ratio ELSE 1.0 END AS split_mult,
                  close * (m2 * CASE WHEN ok3 THEN n3.ratio ELSE 1.0 END) / prev - 1 AS ret_price,
                  (close * (m2 * CASE WHEN ok3 THEN n3.ratio ELSE 1.0 END) + dividend) / prev - 1 AS ret_total FROM b10)
"""

ADJ_SQL = """
  SELECT *, ln(product(1 + coalesce(ret_price, 0)) OVER w) AS lp, ln(product(1 + coalesce(ret_total, 0)) OVER w) AS lt,
         ln(product(1 + coalesce(ret_price, 0)) OVER f) AS lpf, ln(product(1 + coalesce(ret_total, 0)) OVER f) AS ltf,
         last_value(close) OVER f AS last_close
  FROM {src}
  WINDOW w AS (PARTITION BY sid ORDER BY date),
         f AS (PARTITION BY sid ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


def sid_cash(t):
    """Cash events of the test tables by security; the type pairs come from the security master."""
    pairs = t.securities.select("root", F.col("kind").alias("type"), "sid")
    return P.map_cash_events(t.cash_events, pairs)


def sid_stock(t):
    return t.stock_events.dropDuplicates(["sid", "last_date_prior", "multiplier"])


def passes(t):
    return P.split_passes(t.spec_bars, sid_cash(t), sid_stock(t))


def adjusted(t):
    return P.adjusted_prices(t.spec_bars, sid_cash(t), sid_stock(t))


@query("share_type", "sid:i date:t type:s", """
SELECT sid, date, rtrim(split_part(spec, ' ', 1), '*') AS type FROM spec_bars""")
def _(t):
    return t.spec_bars.select("sid", "date", P.share_type(F.col("spec")).alias("type"))


@query("equities_only", "sid:i bars:i volume:2", """
SELECT sid, count(*) AS bars, sum(volume) AS volume FROM spec_bars
WHERE rtrim(split_part(spec, ' ', 1), '*') IN ('ON','PN','PNA','PNB','PNC','PND','PNE','PNF','UNT') GROUP BY sid""")
def _(t):
    return P.equities_only(t.spec_bars).groupBy("sid").agg(F.count("*").alias("bars"), F.sum("volume").alias("volume"))


@query("join_equi_inner", "sid:i last_date_prior:t value:10 label:s", """
SELECT DISTINCT s.sid, e.last_date_prior, e.value, e.label
FROM cash_events e JOIN securities s ON s.root = e.root AND s.kind = e.type""")
def _(t):
    return sid_cash(t)


@query("agg_distinct", "sid:i last_date_prior:t multiplier:4", "SELECT DISTINCT * FROM stock_events")
def _(t):
    return sid_stock(t)


@query("join_next_session", "sid:i last_date_prior:t multiplier:4 ex_date:t", """
SELECT e.*, (SELECT min(b.date) FROM bars b WHERE b.sid = e.sid AND b.date > e.last_date_prior) AS ex_date
FROM (SELECT DISTINCT * FROM stock_events) e""")
def _(t):
    return P.next_session(sid_stock(t), t.bars)


@query("agg_net_split_factor", "sid:i date:t event_mult:6", EVENTS_SQL + "SELECT * FROM m")
def _(t):
    return (P.next_session(sid_stock(t), t.bars).filter("ex_date is not null")
            .groupBy("sid", F.col("ex_date").alias("date")).agg(F.product("multiplier").alias("event_mult")))


@query("win_marker_change", "sid:i date:t marker:s fresh:b", """
SELECT sid, date, marker, (prev IS NULL OR marker <> prev) AND marker = 'EB' AS fresh FROM (
  SELECT *, lag(marker) OVER (PARTITION BY sid ORDER BY date) AS prev FROM (
    SELECT sid, date, CASE WHEN spec LIKE '% EB' THEN 'EB' WHEN spec LIKE '% ED' THEN 'ED' ELSE '' END AS marker FROM spec_bars))""")
def _(t):
    w = ts.by_row()
    df = t.spec_bars.select("sid", "date", P.ex_marker(F.col("spec")).alias("marker")).withColumn("prev", F.lag("marker").over(w))
    return df.withColumn("fresh", (F.col("prev").isNull() | (F.col("marker") != F.col("prev")))
                         & F.substring("marker", 2, 3).rlike("[BGX]"))


@query("split_confirm", "sid:i date:t event_mult:6 accepted:b", PASSES_SQL + """
SELECT sid, date, event_mult, confirmed AS accepted FROM passes WHERE tested""")
def _(t):
    return (passes(t).withColumn("accepted", F.col("m1") != 1)
            .filter(F.col("rejected") | F.col("accepted")))


@query("win_near_event", "sid:i date:t near:b", PASSES_SQL + "SELECT sid, date, near2 = 1 AS near FROM passes")
def _(t):
    w = ts.by_row()
    return passes(t).withColumn("near", P._near("m2", w))


@query("split_infer_marker", "sid:i date:t ratio:6 accepted:b", PASSES_SQL + """
SELECT sid, date, n2.ratio AS ratio, ok2 AS accepted FROM passes WHERE try2""")
def _(t):
    return passes(t).filter("try2").select("sid", "date", F.col("n2.ratio").alias("ratio"), F.col("ok2").alias("accepted"))


@query("split_infer_jump", "sid:i date:t ratio:6 accepted:b", PASSES_SQL + """
SELECT sid, date, n3.ratio AS ratio, ok3 AS accepted FROM passes WHERE try3""")
def _(t):
    return passes(t).filter("try3").select("sid", "date", F.col("n3.ratio").alias("ratio"), F.col("ok3").alias("accepted"))


@query("review_log", "sid:i date:t source:s multiplier:6 accepted:b", PASSES_SQL + """
SELECT sid, date, 'b3_rejected' AS source, event_mult AS multiplier, false AS accepted FROM passes WHERE tested AND NOT confirmed
UNION ALL SELECT sid, date, 'marker_' || marker, n2.ratio, ok2 FROM passes WHERE try2
UNION ALL SELECT sid, date, 'jump', n3.ratio, ok3 FROM passes WHERE try3""")
def _(t):
    return P.review_log(passes(t))


@query("win_total_return", "sid:i date:t ret_price:6 ret_total:6", PASSES_SQL + "SELECT sid, date, ret_price, ret_total FROM passes")
def _(t):
    return P.total_return(passes(t))


@query("win_adj_close", "sid:i date:t adj_log:5 tr_log:5", PASSES_SQL + f""", a AS ({ADJ_SQL.format(src='passes')})
SELECT sid, date, (lp - lpf + ln(last_close)) / ln(10) AS adj_log, (lt - ltf + ln(last_close)) / ln(10) AS tr_log FROM a""")
def _(t):
    return (P.adjusted_close(P.total_return(passes(t)))
            .select("sid", "date", F.log10("adj_close").alias("adj_log"), F.log10("tr_close").alias("tr_log")))


@query("adjusted_prices", "sid:i ticker:s date:t close:8 split_mult:6 dividend:9 ret_total:6 tr_log:5",
       PASSES_SQL + f""", a AS ({ADJ_SQL.format(src='passes')})
SELECT sid, ticker, date, close, split_mult, dividend, ret_total, (lt - ltf + ln(last_close)) / ln(10) AS tr_log FROM a""")
def _(t):
    return adjusted(t).withColumn("tr_log", F.log10("tr_close"))


REFERENCE_SQL = """SELECT ticker, date, CASE WHEN volume > 100000 THEN round(least(close / open - 1, 2), 6) END AS ret FROM spec_bars"""


def _reference(t):
    """Stand-in for the second source: the intraday move, unknown on illiquid days."""
    move = F.round(F.least(F.col("close") / F.col("open") - 1, F.lit(2.0)), 6)
    return t.spec_bars.select("ticker", "date", F.when(F.col("volume") > 100000, move).alias("ret"))


@query("patch_big_moves", "sid:i date:t action:s ret_total:6 tr_log:5", PASSES_SQL + f""",
r AS ({REFERENCE_SQL}),
p AS (
  SELECT a.sid, a.date, a.close, a.ret_price AS rp, a.ret_total AS rt, r.ret,
         CASE WHEN abs(a.ret_total) > 0.25 THEN
           CASE WHEN r.ret IS NULL THEN 'no_reference'
                WHEN abs(a.ret_total - r.ret) > 0.15 AND abs(r.ret) < abs(a.ret_total) THEN 'patched' ELSE 'confirmed' END END AS action
  FROM passes a LEFT JOIN r ON r.ticker = a.ticker AND r.date = a.date),
q AS (SELECT sid, date, close, action, CASE WHEN action = 'patched' THEN ret ELSE rp END AS ret_price,
             CASE WHEN action = 'patched' THEN ret ELSE rt END AS ret_total FROM p),
a AS ({ADJ_SQL.format(src='q')})
SELECT sid, date, action, ret_total, (lt - ltf + ln(last_close)) / ln(10) AS tr_log FROM a""")
def _(t):
    return P.patch_big_moves(adjusted(t), _reference(t)).withColumn("tr_log", F.log10("tr_close"))


SPELLS_SQL = """SELECT ticker || strftime(date, '%Y%m') AS ticker, date, spec, open, close, volume FROM spec_bars"""
RENAMES_SQL = f"""
WITH sp AS ({SPELLS_SQL}),
eq AS (SELECT sp.*, s.sno, rtrim(split_part(spec, ' ', 1), '*') AS type,
         row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS j
       FROM sp JOIN sessions s USING (date) WHERE rtrim(split_part(spec, ' ', 1), '*') <> 'DRN'),
life AS (SELECT ticker, min(sno) AS f, max(sno) AS l, min(date) AS fd, max(date) AS ld, arg_min(open, date) AS open, arg_max(close, date) AS close,
         min(type) AS type, avg(volume) FILTER (i <= 20) AS hv, avg(volume) FILTER (j <= 20) AS tv FROM eq GROUP BY ticker),
pairs AS (SELECT o.ticker AS old, n.ticker AS new, o.ld AS last_date, n.fd AS first_date, round(n.open / o.close - 1, 4) AS price_gap,
          round(n.hv / greatest(o.tv, 1), 2) AS volume_ratio
          FROM life o JOIN life n ON n.f = o.l + 1 AND n.type = o.type
          WHERE o.tv >= 50000 AND abs(n.open / o.close - 1) <= 0.2 AND n.hv / greatest(o.tv, 1) BETWEEN 0.1 AND 10),
renames AS (SELECT * FROM pairs WHERE old IN (SELECT old FROM pairs GROUP BY old HAVING count(*) = 1)
            QUALIFY row_number() OVER (PARTITION BY new ORDER BY abs(price_gap), old) = 1)
"""


def _spells(t):
    """Listings that change their ticker every month, to exercise the rename detector."""
    return t.spec_bars.select(F.concat("ticker", F.date_format("date", "yyyyMM")).alias("ticker"),
                              "date", "spec", "open", "close", "volume")


@query("join_theta_rename", "old:s new:s last_date:t first_date:t price_gap:4 volume_ratio:2",
       RENAMES_SQL + "SELECT * FROM renames")
def _(t):
    return P.detect_renames(_spells(t), t.sessions, min_avg_volume=50_000)


@query("closure_rename_chain", "ticker:s sid:s", RENAMES_SQL.replace("WITH sp", "WITH RECURSIVE sp") + """,
up(ticker, root, depth) AS (
  SELECT new, old, 1 FROM renames UNION ALL SELECT up.ticker, r.old, depth + 1 FROM up JOIN renames r ON r.new = up.root),
top AS (SELECT ticker, arg_max(root, depth) AS root FROM up GROUP BY ticker)
SELECT s.ticker, coalesce(top.root, s.ticker) AS sid FROM (SELECT DISTINCT ticker FROM sp) s LEFT JOIN top ON top.ticker = s.ticker""")
def _(t):
    spells = _spells(t)
    return P.chain_roots(spells, P.detect_renames(spells, t.sessions, min_avg_volume=50_000))


LIQ_SQL = """
WITH reb AS (SELECT min(date) AS rebalance_date FROM sessions WHERE month(date) IN (1, 5, 9) GROUP BY year(date), month(date)),
rows_ AS (SELECT r.rebalance_date, b.* FROM reb r JOIN spec_bars b ON b.date < r.rebalance_date AND b.date >= r.rebalance_date - 365
          WHERE b.kind <> 'DRN'),
tot AS (SELECT rebalance_date, count(DISTINCT date) AS n_sessions, max(date) AS last_session FROM rows_ GROUP BY 1),
stats AS (SELECT rebalance_date, sid, arg_max(ticker, date) AS ticker, sum(trades) AS trades, round(sum(volume), 2) AS volume,
            count(DISTINCT date) AS sessions, arg_max(close, date) AS last_close, max(date) AS last_date FROM rows_ GROUP BY 1, 2),
st AS (SELECT s.*, n_sessions, last_session, sessions / n_sessions AS presence FROM stats s JOIN tot USING (rebalance_date)),
alive AS (SELECT * FROM st WHERE presence >= 0.15 AND last_close >= 1 AND last_date >= last_session - 10),
idx AS (SELECT *, sqrt((trades / sum(trades) OVER w) * (volume / sum(volume) OVER w)) AS in_index FROM alive
        WINDOW w AS (PARTITION BY rebalance_date)),
uni AS (SELECT *, row_number() OVER (PARTITION BY rebalance_date ORDER BY in_index DESC, sid) AS rank FROM idx QUALIFY rank <= 60)
"""
UNIVERSE = dict(min_presence=0.15, max_idle_days=10)


@query("agg_liquidity_stats", "rebalance_date:t sid:i ticker:s trades:i volume:2 sessions:i last_close:8 last_date:t presence:6",
       LIQ_SQL + "SELECT * FROM st")
def _(t):
    return P.liquidity_stats(t.spec_bars, t.sessions)


@query("agg_negotiability_index", "rebalance_date:t sid:i in_index:8", LIQ_SQL + "SELECT * FROM idx")
def _(t):
    return P.negotiability_index(P.liquidity_stats(t.spec_bars, t.sessions), **UNIVERSE)


def universe(t):
    return P.universe_history(t.spec_bars, t.sessions, size=60, **UNIVERSE)


@query("topk_liquid", "rebalance_date:t sid:i rank:i", LIQ_SQL + "SELECT * FROM uni")
def _(t):
    return universe(t)


@query("universe_history", "rebalance_date:t sid:i ticker:s rank:i in_index:8 presence:6 volume:2 last_close:8", LIQ_SQL + "SELECT * FROM uni")
def _(t):
    return universe(t)


MONTHS_SQL = """SELECT max(date) AS t FROM sessions GROUP BY date_trunc('month', date)"""


@query("join_membership_asof", "t:t rebalance_date:t sid:i rank:i", LIQ_SQL + f""",
me AS ({MONTHS_SQL}),
f AS (SELECT t, (SELECT max(rebalance_date) FROM uni WHERE rebalance_date <= t) AS rebalance_date FROM me)
SELECT f.t, f.rebalance_date, u.sid, u.rank FROM f JOIN uni u USING (rebalance_date)""")
def _(t):
    return P.members_at(ts.month_ends(t.sessions).select("t"), universe(t))


SCD_SQL = """SELECT s.sid, CASE WHEN s.sid % 9 <> 0 THEN min(date) + 400 END AS inclusion_date,
  CASE WHEN s.sid % 4 = 0 THEN max(date) - 200 END AS exclusion_date FROM bars s GROUP BY s.sid"""


def scd(t):
    return t.bars.groupBy("sid").agg(F.min("date").alias("a"), F.max("date").alias("b")).select(
        "sid", F.when(F.col("sid") % 9 != 0, F.date_add("a", 400)).alias("inclusion_date"),
        F.when(F.col("sid") % 4 == 0, F.date_sub("b", 200)).alias("exclusion_date"))


@query("universe_as_of", "as_of:t sid:i", f"""
WITH scd AS ({SCD_SQL}), me AS ({MONTHS_SQL})
SELECT t AS as_of, sid FROM me JOIN scd ON coalesce(inclusion_date, DATE '1900-01-01') <= t AND (exclusion_date IS NULL OR exclusion_date > t)""")
def _(t):
    # the dates ride along as an array bounded by the calendar; each row keeps those it was a member on
    months = ts.month_ends(t.sessions).agg(F.sort_array(F.collect_list("t")).alias("dates"))
    rows = scd(t).join(F.broadcast(months)).withColumn("as_of", F.explode("dates"))
    return P.universe_as_of(rows, F.col("as_of"))


@query("clean_bars", "sid:i date:t close:8 intraday:b", """
WITH b AS (SELECT sid, date, close, open <= 0 OR high <= 0 OR low <= 0 OR vol <= 0 AS bad, lead(date) OVER (PARTITION BY sid ORDER BY date) IS NULL AS last_bar
  FROM (SELECT *, CASE WHEN trades > 1 AND sid % 2 = 0 THEN 0 ELSE volume END AS vol FROM bars))
SELECT sid, date, close, last_bar AND (bad OR date = DATE '2001-10-30') AS intraday FROM b WHERE last_bar OR NOT bad""")
def _(t):
    dirty = t.bars.withColumn("volume", F.when((F.col("trades") > 1) & (F.col("sid") % 2 == 0), 0.0).otherwise(F.col("volume")))
    return P.clean_bars(dirty, F.lit("2001-10-30 15:00:00").cast("timestamp"))


@query("fn_rate_to_daily", "sid:i date:t daily:10", """
WITH s AS (SELECT sid, date, CASE WHEN sid % 3 = 0 THEN ln(px) / 200 WHEN sid % 3 = 1 THEN ln(px) / 10000 ELSE ln(px) * 3 END AS rate
           FROM (SELECT sid, date, close AS px FROM bars)),
m AS (SELECT sid, quantile_cont(rate, 0.5) AS med FROM s GROUP BY sid),
c AS (SELECT sid, med, med > 1 AS yearly, med / 100 AS d, pow(1 + med / 100, 1.0 / 252) - 1 AS y FROM m),
u AS (SELECT sid, yearly <> (NOT (CASE WHEN yearly THEN y ELSE d END BETWEEN 0.00005 AND 0.002)
                            AND (CASE WHEN yearly THEN d ELSE y END BETWEEN 0.00005 AND 0.002)) AS use_yearly FROM c)
SELECT s.sid, date, CASE WHEN use_yearly THEN pow(1 + rate / 100, 1.0 / 252) - 1 ELSE rate / 100 END AS daily FROM s JOIN u USING (sid)""")
def _(t):
    level = F.log("close")
    rate = F.when(F.col("sid") % 3 == 0, level / 200).when(F.col("sid") % 3 == 1, level / 10000).otherwise(level * 3)
    return P.fix_rate(t.bars.select("sid", "date", rate.alias("rate")), "rate", ["sid"])
