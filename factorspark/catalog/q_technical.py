"""Technical indicator queries."""

from pyspark.sql import functions as F

from factorspark.catalog.registry import query
from factorspark.operators import technical as T
from factorspark.operators import timeseries as ts
from factorspark.operators import volatility as V

NUM_SQL = """
WITH RECURSIVE r AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY sid) AS n, close - lag(close) OVER w AS d
  FROM bars WINDOW w AS (PARTITION BY sid ORDER BY date)),
rj AS (SELECT *, n - i + 1 AS j FROM r),
wild AS (
  SELECT sid, i, avg(greatest(d, 0)) OVER s AS g, avg(greatest(-d, 0)) OVER s AS l, avg(abs(d)) OVER s AS a FROM r WHERE i BETWEEN 2 AND 15
  WINDOW s AS (PARTITION BY sid)),
wl AS (
  SELECT DISTINCT sid, CAST(15 AS BIGINT) AS i, g, l, a FROM wild
  UNION ALL
  SELECT wl.sid, r.i, (wl.g * 13 + greatest(r.d, 0)) / 14, (wl.l * 13 + greatest(-r.d, 0)) / 14, (wl.a * 13 + abs(r.d)) / 14
  FROM wl JOIN r ON r.sid = wl.sid AND r.i = wl.i + 1),
wlast AS (SELECT sid, arg_max(g, i) AS g, arg_max(l, i) AS l, arg_max(a, i) AS atr FROM wl GROUP BY sid),
mc AS (
  SELECT sid, i, close AS f, close AS w, CAST(0 AS DOUBLE) AS sg, CAST(0 AS DOUBLE) AS h FROM r WHERE i = 1
  UNION ALL
  SELECT sid, i, f, w, sg + 0.2 * (f - w - sg), (f - w) - (sg + 0.2 * (f - w - sg)) FROM (
    SELECT mc.sid, r.i, mc.f + 2.0 / 13 * (r.close - mc.f) AS f, mc.w + 2.0 / 27 * (r.close - mc.w) AS w, mc.sg
    FROM mc JOIN r ON r.sid = mc.sid AND r.i = mc.i + 1)),
ml AS (SELECT sid, arg_max(f, i) AS ema_fast, arg_max(w, i) AS ema_slow, arg_max(f - w, i) AS macd_line, arg_max(sg, i) AS macd_signal, arg_max(h, i) AS h,
       arg_max(h, i) FILTER (i < n) AS ph FROM mc JOIN (SELECT DISTINCT sid, n FROM r) USING (sid) GROUP BY sid),
g AS (
  SELECT sid, max(n) AS n, max(close) FILTER (j = 1) AS price, max(close) FILTER (j = 2) AS price_prev, max(open) FILTER (j = 1) AS last_open,
    max(volume) FILTER (j = 1) AS last_volume, avg(volume) FILTER (j BETWEEN 2 AND 5) AS avg_volume,
    CASE WHEN max(n) >= 20 THEN avg(close) FILTER (j <= 20) END AS ma20, CASE WHEN max(n) >= 50 THEN avg(close) FILTER (j <= 50) END AS ma50,
    CASE WHEN max(n) >= 200 THEN avg(close) FILTER (j <= 200) END AS ma200, stddev_pop(close) FILTER (j <= 20) AS sd,
    max(close) FILTER (j <= 252) AS high_52w, min(close) FILTER (j <= 252) AS low_52w FROM rj GROUP BY sid),
x AS (
  SELECT g.*, atr, CASE WHEN l = 0 THEN CASE WHEN wlast.g > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + wlast.g / l) END AS rsi,
    ema_fast, ema_slow, macd_line, macd_signal, h AS macd_hist, macd_line > macd_signal AS macd_above,
    CASE WHEN ph < 0 AND h >= 0 THEN 'bullish' WHEN ph > 0 AND h <= 0 THEN 'bearish' END AS macd_cross,
    greatest(-0.2, least(1.2, (price - (ma20 - 2 * sd)) / (4 * sd))) AS bb_position, 4 * sd / ma20 AS bb_width,
    price / price_prev - 1 AS change_1d, price / high_52w - 1 AS from_high, price / low_52w - 1 AS from_low,
    last_open / price_prev - 1 AS gap, last_volume / avg_volume AS volume_ratio
  FROM g JOIN wlast USING (sid) JOIN ml USING (sid) WHERE n >= 35),
tp AS (
  SELECT *, CASE WHEN price > ma20 AND ma20 > ma50 AND ma50 > ma200 THEN 'uptrend' WHEN ma200 IS NOT NULL AND price < ma20 AND ma20 < ma50 THEN 'downtrend'
      WHEN price > ma20 AND price > ma50 THEN 'uptrend' WHEN price < ma20 AND price < ma50 THEN 'downtrend' ELSE 'sideways' END AS trend,
    round(CASE WHEN rsi < 30 THEN 1.0 WHEN rsi < 45 THEN 0.4 WHEN rsi > 70 THEN -1.0 WHEN rsi > 55 THEN -0.4 ELSE 0 END
      + CASE WHEN ma20 IS NULL THEN 0 WHEN price > ma20 THEN 0.5 ELSE -0.5 END + CASE WHEN ma50 IS NULL THEN 0 WHEN price > ma50 THEN 0.5 ELSE -0.5 END
      + CASE WHEN ma200 IS NULL THEN 0 WHEN price > ma200 THEN 0.25 ELSE -0.25 END + CASE WHEN macd_above THEN 0.4 ELSE -0.4 END
      + CASE macd_cross WHEN 'bullish' THEN 0.5 WHEN 'bearish' THEN -0.5 ELSE 0 END
      + CASE WHEN bb_position < 0.15 THEN 0.5 WHEN bb_position > 0.85 THEN -0.5 ELSE 0 END, 6) AS sc FROM x),
tech AS (SELECT *, CASE WHEN sc > 1.5 THEN 'strong_buy' WHEN sc > 0.5 THEN 'buy' WHEN sc < -1.5 THEN 'strong_sell' WHEN sc < -0.5 THEN 'sell'
      ELSE 'neutral' END AS signal, abs(from_high) < 0.03 AS near_high, from_low < 0.05 AS near_low FROM tp)
"""


def panel(t):
    return T.technical_panel(t.bars).filter("n >= 35")


_PICK = {
    "win_sma": "sid:i ma20:5 ma50:5 ma200:5",
    "win_bollinger": "sid:i bb_position:6 bb_width:6",
    "win_macd": "sid:i macd_line:5 macd_signal:5 macd_hist:5 macd_cross:s macd_above:b",
    "win_ema": "sid:i ema_fast:5 ema_slow:5",
    "win_wilder_rsi": "sid:i rsi:6",
    "win_wilder_atr": "sid:i atr:5",
    "win_52w": "sid:i high_52w:8 low_52w:8 from_high:6 from_low:6 near_high:b near_low:b",
    "win_gap_volume": "sid:i gap:6 volume_ratio:6 change_1d:6",
    "technical_panel": "sid:i n:i price:8 rsi:6 macd_hist:5 bb_position:6 ma50:5 atr:5 high_52w:8 trend:s signal:s",
    "technical_signal": "sid:i trend:s signal:s",
}
for _name, _cols in _PICK.items():
    query(_name, _cols, NUM_SQL + "SELECT * FROM tech")(panel)


@query("technical_alerts", "sid:i type:s value:6", NUM_SQL + """
SELECT sid, 'gap_up' AS type, gap AS value FROM tech WHERE gap > 0.02 UNION ALL SELECT sid, 'gap_down', gap FROM tech WHERE gap < -0.02
UNION ALL SELECT sid, 'volume_spike', volume_ratio FROM tech WHERE volume_ratio >= 2
UNION ALL SELECT sid, 'near_52w_high', from_high FROM tech WHERE near_high UNION ALL SELECT sid, 'near_52w_low', from_low FROM tech WHERE near_low
UNION ALL SELECT sid, 'macd_' || macd_cross, NULL FROM tech WHERE macd_cross IS NOT NULL
UNION ALL SELECT sid, 'oversold', rsi FROM tech WHERE rsi < 30 UNION ALL SELECT sid, 'overbought', rsi FROM tech WHERE rsi > 70""")
def _(t):
    return T.technical_alerts(panel(t))


# the scanner's inputs: indicators, a stand-in total score, volatility and beta
SCAN_SQL = NUM_SQL + """,
sc AS (SELECT t.* EXCLUDE (sc), f.pvp, 40 + (t.sid * 61 % 120) / 2 AS total_score, (t.sid * 7 % 50) / 100 AS vol, f.beta,
       CASE WHEN f.pl > 0 THEN 1 / f.pl END AS earnings_yield, f.dividend_yield, f.roe, f.sector, (t.sid * 3 % 40) / 100 - 0.2::DOUBLE AS alpha_6m
       FROM tech t JOIN fundamentals f USING (sid)),
cr AS (SELECT *, total_score >= 72 AS p_score, signal IN ('buy', 'strong_buy') AS p_signal, rsi BETWEEN 28 AND 48 AS p_rsi, macd_above AS p_macd,
       coalesce(macd_cross = 'bullish', false) AS s_cross, volume_ratio >= 1.5 AS s_volume, bb_position <= 0.35 AS s_bb FROM sc),
c2 AS (SELECT *, p_score::INT + p_signal::INT + p_rsi::INT + p_macd::INT AS primary_hits, s_cross::INT + s_volume::INT + s_bb::INT AS secondary_hits FROM cr),
c3 AS (SELECT *, primary_hits = 4 AND secondary_hits >= 2 AS qualified FROM c2),
crit AS (SELECT *, NOT qualified AND primary_hits >= 3 AS near_miss FROM c3)
"""


def scan_input(t):
    sid = F.col("sid")
    f = t.fundamentals.select("sid", "pvp", "beta", "dividend_yield", "roe", "sector",
                              F.when(F.col("pl") > 0, 1 / F.col("pl")).alias("earnings_yield"))
    return (panel(t).join(f, "sid").withColumn("total_score", 40 + (sid * 61 % 120) / 2)
            .withColumn("vol", (sid * 7 % 50) / 100).withColumn("alpha_6m", (sid * 3 % 40) / 100 - 0.2))


@query("scan_criteria", "sid:i primary_hits:i secondary_hits:i qualified:b near_miss:b", SCAN_SQL + "SELECT * FROM crit")
def _(t):
    return T.scan_criteria(scan_input(t))


@query("agg_scan_counts", "n_evaluated:i n_primary:i p_score:i p_signal:i p_rsi:i p_macd:i s_cross:i s_volume:i s_bb:i qualified:i near_miss:i",
       SCAN_SQL + """SELECT count(*) AS n_evaluated, count_if(primary_hits = 4) AS n_primary, count_if(p_score) AS p_score, count_if(p_signal) AS p_signal,
 count_if(p_rsi) AS p_rsi, count_if(p_macd) AS p_macd, count_if(s_cross) AS s_cross, count_if(s_volume) AS s_volume, count_if(s_bb) AS s_bb,
 count_if(qualified) AS qualified, count_if(near_miss) AS near_miss FROM crit""")
def _(t):
    return T.scan_counts(T.scan_criteria(scan_input(t)))


@query("opportunity_scan", "sid:i stop_loss:2 entry_low:2 target1:2 target2:2 risk:s horizon:s", SCAN_SQL.replace("total_score >= 72", "total_score >= 45").replace("28 AND 48", "28 AND 60").replace("secondary_hits >= 2 AS", "secondary_hits >= 1 AS") + """,
lv AS (SELECT *, list_sort(list_filter([ma20, ma50, ma200, high_52w], lambda x: x IS NOT NULL AND x > price * 1.015)) AS ls FROM crit WHERE qualified)
SELECT sid, round(price * 0.93, 2) AS stop_loss, round(price * 0.98, 2) AS entry_low,
  CASE WHEN len(ls) = 0 THEN round(price * 1.10, 2) ELSE round(ls[1], 2) END AS target1,
  CASE WHEN len(ls) = 0 THEN round(price * 1.20, 2) WHEN len(ls) = 1 THEN round(round(ls[1], 2) * 1.08, 2) ELSE round(ls[2], 2) END AS target2,
  CASE WHEN vol > 0.40 OR (CASE WHEN beta = 0 THEN 1 ELSE beta END) > 1.6 THEN 'Alto'
       WHEN vol < 0.22 AND (CASE WHEN beta = 0 THEN 1 ELSE beta END) < 0.85 THEN 'Baixo' ELSE 'Moderado' END AS risk,
  CASE WHEN signal = 'strong_buy' AND secondary_hits = 3 THEN '1-4' WHEN total_score >= 80 AND secondary_hits >= 2 THEN '2-6' ELSE '3-8' END AS horizon
FROM lv""")
def _(t):
    return (T.opportunity_scan(scan_input(t), min_score=45.0, rsi_range=(28.0, 60.0), min_secondary=1).withColumn("target1", F.col("targets")[0])
            .withColumn("target2", F.col("targets")[1]))


@query("agg_sector_medians", "sector:s sector_ey:6 sector_pvp:6", """
WITH f AS (SELECT sector, CASE WHEN pl > 0 THEN 1 / pl END AS ey, CASE WHEN pvp > 0 THEN pvp END AS pvp FROM fundamentals)
SELECT sector, CASE WHEN count(*) >= 2 AND count(ey) >= 2 THEN quantile_cont(ey, 0.5) END AS sector_ey,
 CASE WHEN count(*) >= 2 AND count(pvp) >= 2 THEN quantile_cont(pvp, 0.5) END AS sector_pvp FROM f GROUP BY sector""")
def _(t):
    return T.sector_medians(t.fundamentals.withColumn("earnings_yield", F.when(F.col("pl") > 0, 1 / F.col("pl"))))


LEVELS_SQL = SCAN_SQL + """,
sm AS (SELECT sector, CASE WHEN count(*) >= 2 AND count(CASE WHEN earnings_yield > 0 THEN 1 END) >= 2 THEN quantile_cont(earnings_yield, 0.5) FILTER (earnings_yield > 0) END AS ey_med,
  CASE WHEN count(CASE WHEN pvp > 0 THEN 1 END) >= 2 THEN quantile_cont(pvp, 0.5) FILTER (pvp > 0) END AS pvp_med FROM sc GROUP BY sector),
a1 AS (SELECT sc.*, CASE WHEN earnings_yield <> 0 AND ey_med > 0 AND 1 / ey_med <= 60 THEN round(price * earnings_yield * (1 / ey_med), 2) END AS target_pl,
  CASE WHEN pvp > 0 AND pvp_med > 0 AND price / pvp * pvp_med <= price * 3 THEN round(price / pvp * pvp_med, 2) END AS target_pvp,
  CASE WHEN earnings_yield > 0 AND pvp > 0 THEN round(sqrt(round(22.5 * (0.04 / 0.1), 4) * price * earnings_yield * (price / pvp)), 2) END AS target_graham
  FROM sc LEFT JOIN sm USING (sector)),
a2 AS (SELECT *, list_sort(list_filter(list_concat([target_pl, target_pvp, target_graham], [round(x, 2) FOR x IN [ma20, ma50, ma200, high_52w] IF x > price]),
  lambda x: x IS NOT NULL AND x > price * 1.025)) AS lv FROM a1),
a3 AS (SELECT *, CASE WHEN len(lv) > 0 THEN lv[1] ELSE round(price * 1.10, 2) END AS target_conservative,
  CASE WHEN len(lv) > 0 THEN lv[-1] ELSE round(price * 1.20, 2) END AS ext,
  least(greatest(CASE WHEN atr > 0 AND atr < price * 0.10 THEN round(price - 2 * atr, 2) WHEN ma50 > price * 0.88 AND ma50 < price THEN round(ma50 * 0.99, 2)
    ELSE round(price * 0.93, 2) END, round(price * 0.90, 2)), round(price * 0.97, 2)) AS stop,
  coalesce(pvp < 1.3, false) OR coalesce(dividend_yield > 0.05, false) AS is_v,
  coalesce(alpha_6m > 0.06, false) OR coalesce(signal = 'strong_buy' AND macd_cross = 'bullish', false) AS is_m, coalesce(roe > 0.18, false) AS is_q FROM a2),
levels AS (SELECT *, CASE WHEN ext <= target_conservative THEN round(target_conservative * 1.10, 2) ELSE ext END AS target_extended,
  CASE WHEN target_conservative > price THEN round((target_conservative - price) / greatest(price - stop, 0.01), 2) ELSE 0 END AS rr,
  CASE WHEN is_v::INT + is_m::INT + is_q::INT >= 2 THEN 'Misto' WHEN is_v THEN 'Valor' WHEN is_m THEN 'Momentum' WHEN is_q THEN 'Qualidade' ELSE 'Misto' END AS opportunity_type,
  CASE WHEN coalesce(signal = 'strong_buy' AND macd_cross = 'bullish' AND rsi < 38, false) THEN '1-4'
       WHEN total_score >= 80 AND signal IN ('buy', 'strong_buy') THEN '2-6' ELSE '3-8' END AS horizon FROM a3)
"""


def levels(t):
    return T.trade_levels(scan_input(t), F.lit(0.1))


@query("trade_levels", "sid:i target_pl:2 target_pvp:2 target_graham:2 target_conservative:2 target_extended:2 stop:2 rr:2 opportunity_type:s horizon:s",
       LEVELS_SQL + "SELECT * FROM levels")
def _(t):
    return levels(t)


LEVEL_ALERTS_SQL = """
WITH lv AS (SELECT sid, date, close AS price, lag(close, 5) OVER w * 0.9 AS stop, lag(close, 5) OVER w * 1.2 AS target FROM bars WINDOW w AS (PARTITION BY sid ORDER BY date))
SELECT sid, date, 'stop_hit' AS kind, 0 AS severity, stop AS level, round((price - stop) / price, 4) AS distance_pct FROM lv WHERE price <= stop
UNION ALL SELECT sid, date, 'stop_near', 1, stop, round((price - stop) / price, 4) FROM lv WHERE price > stop AND (price - stop) / price < 0.02
UNION ALL SELECT sid, date, 'target_hit', 2, target, round((price - target) / price, 4) FROM lv WHERE price > stop AND price >= target"""


def alerts(t):
    """Every session's close against the levels set five sessions of the name before."""
    w = ts.by_row()
    lv = t.bars.select("sid", "date", (F.lag("close", 5).over(w) * 0.9).alias("stop"), (F.lag("close", 5).over(w) * 1.2).alias("target"))
    return T.level_alerts(lv, t.bars.select("sid", "date", F.col("close").alias("price")), ["sid", "date"])


@query("level_alerts", "sid:i date:t kind:s severity:i level:9 distance_pct:4", LEVEL_ALERTS_SQL)
def _(t):
    return alerts(t)


@query("join_stream_static_levels", "sid:i date:t kind:s level:9", LEVEL_ALERTS_SQL)
def _(t):
    return alerts(t)


@query("sort_alerts", "severity:i sid:i date:t kind:s", LEVEL_ALERTS_SQL)
def _(t):
    return alerts(t).orderBy("severity", "sid", "date")


@query("agg_yang_zhang_vol", "sid:i vol_yz:6", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY date DESC) AS j FROM bars QUALIFY j <= 180),
x AS (SELECT sid, ln(open / lag(close) OVER (PARTITION BY sid ORDER BY date)) AS night, ln(close / open) AS day,
      ln(high / open) * (ln(high / open) - ln(close / open)) + ln(low / open) * (ln(low / open) - ln(close / open)) AS rs FROM r),
g AS (SELECT sid, count(*) AS n, var_samp(night) AS vn, var_samp(day) AS vd, avg(rs) AS rs FROM x GROUP BY sid),
k AS (SELECT *, 0.34 / (1.34 + (n + 1) / (n - 1)) AS k FROM g)
SELECT sid, CASE WHEN n >= 20 AND vn + k * vd + (1 - k) * rs > 0 THEN sqrt((vn + k * vd + (1 - k) * rs) * 252) END AS vol_yz FROM k""")
def _(t):
    return V.yang_zhang(t.bars)


@query("win_vol_fallback", "sid:i vol:6", """
WITH b AS (SELECT * REPLACE (CASE WHEN trades > 1 AND (sid % 3 <> 0 OR date < DATE '1996-03-01') THEN open END AS open) FROM bars),
q AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY date DESC) AS j FROM b QUALIFY j <= 180), r AS (SELECT * FROM q WHERE open > 0),
x AS (SELECT sid, ln(open / lag(close) OVER (PARTITION BY sid ORDER BY date)) AS night, ln(close / open) AS day,
      ln(high / open) * ln(high / close) + ln(low / open) * ln(low / close) AS rs FROM r),
g AS (SELECT sid, count(*) AS n, coalesce(var_samp(night), 0) AS vn, coalesce(var_samp(day), 0) AS vd, avg(rs) AS rs FROM x GROUP BY sid),
k AS (SELECT *, CASE WHEN n > 1 THEN 0.34 / (1.34 + (n + 1) / (n - 1)) END AS k FROM g),
yz AS (SELECT sid, CASE WHEN n >= 20 AND vn + k * vd + (1 - k) * rs > 0 THEN sqrt((vn + k * vd + (1 - k) * rs) * 252) END AS v FROM k),
cr AS (SELECT sid, date, close / lag(close) OVER (PARTITION BY sid ORDER BY date) - 1 AS r FROM bars),
cl AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY date DESC) AS j FROM cr WHERE r IS NOT NULL QUALIFY j <= 180),
cc AS (SELECT sid, CASE WHEN count(*) >= 29 THEN stddev_samp(r) * sqrt(252) END AS v FROM cl GROUP BY sid)
SELECT cc.sid, coalesce(yz.v, cc.v) AS vol FROM cc LEFT JOIN yz USING (sid)""")
def _(t):
    # no opening price on days of one trade, nor for a third of the securities from a date on
    quoted = (F.col("trades") > 1) & ((F.col("sid") % 3 != 0) | (F.col("date") < "1996-03-01"))
    thin = t.bars.withColumn("open", F.when(quoted, F.col("open")))
    return (V.close_to_close(t.bars).join(V.yang_zhang(thin), "sid", "left")
            .select("sid", F.coalesce("vol_yz", "vol_cc").alias("vol")))


@query("win_ewma_vol", "sid:i n:i vol_ewma:5 gross:5", """
WITH RECURSIVE r0 AS (SELECT sid, date, close / lag(close) OVER (PARTITION BY sid ORDER BY date) - 1 AS r FROM bars),
r1 AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY date DESC) AS j FROM r0 WHERE r IS NOT NULL QUALIFY j <= 251),
r AS (SELECT sid, r, row_number() OVER (PARTITION BY sid ORDER BY date) AS i FROM r1),
e AS (SELECT sid, i, r * r AS v FROM r WHERE i = 1 UNION ALL SELECT e.sid, r.i, 0.94 * e.v + 0.06 * r.r * r.r FROM e JOIN r ON r.sid = e.sid AND r.i = e.i + 1),
l AS (SELECT sid, max(i) AS n, CASE WHEN max(i) >= 30 THEN sqrt(252 * arg_max(v, i)) END AS vol_ewma FROM e GROUP BY sid)
SELECT *, coalesce(greatest(0.5, least(1.0, 0.14 / vol_ewma)), 1) AS gross FROM l""")
def _(t):
    w = ts.by_row()
    rets = t.bars.select("sid", "date", ts.returns("close", w).alias("ret"))
    return V.ewma_vol(rets, ["sid"]).withColumn("gross", V.gross_exposure(F.col("vol_ewma")))


@query("agg_adv_median", "sid:i adv:4", """
SELECT sid, quantile_cont(close * quantity, 0.5) AS adv FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY date DESC) AS j FROM bars) WHERE j <= 21 GROUP BY sid""")
def _(t):
    return V.adv_median(t.bars)


BETA_SQL = """
WITH s AS (SELECT sid, date, close / lag(close) OVER (PARTITION BY sid ORDER BY date) - 1 AS r, ln(close / lag(close) OVER (PARTITION BY sid ORDER BY date)) AS lr FROM bars),
m AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS m, ln(close / lag(close) OVER (ORDER BY date)) AS lm FROM index_close),
x AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY date DESC) AS j FROM s JOIN m USING (date) WHERE r IS NOT NULL AND m IS NOT NULL)
"""


def stock_and_market(t, log=False):
    w, wi = ts.by_row(), ts.by_row("_k")
    r = t.bars.select("sid", "date", ts.returns("close", w, log=log).alias("r"))
    m = t.index_close.withColumn("_k", F.lit(1)).select("date", ts.returns("close", wi, log=log).alias("m"))
    return r, m


@query("agg_beta", "sid:i beta:5", BETA_SQL + """
SELECT sid, CASE WHEN count(*) >= 60 THEN covar_samp(r, m) / var_samp(m) END AS beta FROM x WHERE j <= 252 GROUP BY sid""")
def _(t):
    return V.beta(*stock_and_market(t))


@query("agg_beta_with_fallback", "sid:i beta:5", BETA_SQL + """,
pb AS (SELECT sid, CASE WHEN count(*) >= 240 AND sid % 3 <> 0 THEN covar_samp(r, m) / var_samp(m) END AS b FROM x WHERE j <= 252 GROUP BY sid)
SELECT f.sid, coalesce(pb.b, CASE WHEN f.beta BETWEEN -0.5 AND 3.0 THEN f.beta END) AS beta FROM fundamentals f LEFT JOIN pb USING (sid)""")
def _(t):
    r, m = stock_and_market(t)
    price = V.beta(r.filter("sid % 3 <> 0"), m, min_rows=240).withColumnRenamed("beta", "price_beta")
    source = F.when(F.col("beta").between(-0.5, 3.0), F.col("beta"))
    return t.fundamentals.join(price, "sid", "left").select("sid", F.coalesce("price_beta", source).alias("beta"))


@query("agg_fx_corr", "sid:i corr:6", BETA_SQL + """
SELECT sid, CASE WHEN count(*) >= 30 THEN corr(lr, lm) END AS corr FROM x WHERE j <= 90 GROUP BY sid""")
def _(t):
    return V.fx_corr(*stock_and_market(t, log=True))


@query("join_intersect_dates", "sid:i date:t r:6 m:6", BETA_SQL + "SELECT * FROM x")
def _(t):
    r, m = stock_and_market(t)
    return r.filter("r is not null").join(m.filter("m is not null"), "date")
