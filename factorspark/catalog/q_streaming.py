"""Streaming queries: the whole tick table as a stream, run until everything available is done."""

from pyspark.sql import functions as F

from factorspark.catalog.registry import query
from factorspark.session import shared_dir
from factorspark.streaming import jobs as J
from factorspark.streaming.nav_table import NavTable, start


def ticks(t):
    return J.tick_stream(t.spark, t.root, "events.parquet", t.raw("events").schema)


DAY_SQL = """
WITH mx AS (SELECT max(ts) - INTERVAL 2 DAY AS wm FROM ticks),
d AS (SELECT sid, CAST(ts AS DATE) AS date, first(px ORDER BY ts, event_id) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY ts, event_id) AS close, sum(px) AS volume, count(*) AS trades FROM ticks GROUP BY ALL)
SELECT d.* FROM d, mx WHERE date + INTERVAL 1 DAY <= wm"""


@query("stream_daily_bars", "sid:i date:t open:2 high:2 low:2 close:2 volume:2 trades:i", DAY_SQL)
def _(t):
    return J.run_to_table(J.daily_bars(ticks(t)), shared_dir(t.spark, "stream"), "bars")


@query("stream_rolling_activity", "sid:i start:t volume:2 trades:i", """
WITH mx AS (SELECT max(ts) - INTERVAL 2 DAY AS wm FROM ticks), k AS (SELECT unnest(range(5)) AS k),
w AS (SELECT sid, CAST(CAST(ts AS DATE) - CAST(k AS INTEGER) AS DATE) AS start, sum(px) AS volume, count(*) AS trades FROM ticks, k GROUP BY ALL)
SELECT w.* FROM w, mx WHERE start + INTERVAL 5 DAY <= wm""")
def _(t):
    return J.run_to_table(J.rolling_activity(ticks(t)), shared_dir(t.spark, "stream"), "activity")


@query("stream_level_alerts", "sid:i day:t kind:s", """
SELECT DISTINCT sid, CAST(ts AS DATE) AS day, CASE WHEN px <= 0.5 + sid % 3 THEN 'stop_hit' WHEN (px - (0.5 + sid % 3)) / px < 0.02 THEN 'stop_near' ELSE 'target_hit' END AS kind
FROM ticks WHERE px <= 0.5 + sid % 3 OR (px - (0.5 + sid % 3)) / px < 0.02 OR px >= 100 + sid % 50""")
def _(t):
    sid = F.col("sid")
    levels = t.ticks.select("sid").distinct().select("sid", (0.5 + sid % 3).alias("stop"), (100.0 + sid % 50).alias("target"))
    return J.run_to_table(J.level_alerts(ticks(t), levels), shared_dir(t.spark, "stream"), "alerts")


@query("stream_revised_bars", "sid:i date:t open:2 high:2 low:2 close:2 volume:2 trades:i final:b", """
WITH mx AS (SELECT max(ts) - INTERVAL 2 DAY AS wm FROM ticks),
d AS (SELECT sid, CAST(ts AS DATE) AS date, first(px ORDER BY ts, event_id) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY ts, event_id) AS close, sum(px) AS volume, count(*) AS trades FROM ticks GROUP BY ALL)
SELECT d.*, epoch_ms(date + INTERVAL 1 DAY) <= epoch_ms(wm) AS final FROM d, mx""")
def _(t):
    own = J.stateful_session(t.spark)
    ticks_there = J.tick_stream(own, t.root, "events.parquet", t.raw("events").schema)
    folder = shared_dir(t.spark, "stream")
    told = t.spark.read.parquet(stored(J.run_updates(J.revised_bars(ticks_there), folder), folder))
    rest = [c for c in told.columns if c not in ("sid", "date")]
    return told.groupBy("sid", "date").agg(F.max_by(F.struct(*rest), "revision").alias("v")).select("sid", "date", "v.*")


@query("stream_levels_in_force", "sid:i day:t kind:s", """
WITH mx AS (SELECT epoch_ms(max(ts)) - 172800000 AS wm FROM ticks),
v AS (SELECT sid, ts, arg_max(px, event_id) * 0.9 AS stop, arg_max(px, event_id) * 1.2 AS target FROM ticks WHERE event_type = 'purchase' GROUP BY sid, ts),
k AS (SELECT sid, ts, px FROM ticks, mx WHERE event_type <> 'purchase' AND px > 0 AND epoch_ms(ts) < wm),
j AS (SELECT k.sid, CAST(k.ts AS DATE) AS day, k.px, CASE WHEN v.stop > 0 THEN v.stop END AS stop, CASE WHEN v.target > 0 THEN v.target END AS target FROM k ASOF JOIN v ON k.sid = v.sid AND k.ts >= v.ts)
SELECT DISTINCT sid, day, 'stop_hit' AS kind FROM j WHERE px <= stop
UNION ALL SELECT DISTINCT sid, day, 'stop_near' FROM j WHERE px > stop AND (px - stop) / px < 0.02
UNION ALL SELECT DISTINCT sid, day, 'target_hit' FROM j WHERE NOT coalesce(px <= stop, false) AND px >= target""")
def _(t):
    own = J.stateful_session(t.spark)
    ticks_there = J.tick_stream(own, t.root, "events.parquet", t.raw("events").schema)
    entries = ticks_there.filter("event_type = 'purchase'").select("sid", "ts", F.col("event_id").alias("version"), (F.col("px") * 0.9).alias("stop"), (F.col("px") * 1.2).alias("target"))
    folder = shared_dir(t.spark, "stream")
    return t.spark.read.parquet(stored(J.run_to_table(J.level_alerts_in_force(ticks_there.filter("event_type <> 'purchase'"), entries), folder, "alerts"), folder))


@query("stream_scan_log", "month:s n:i", "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM ticks WHERE event_type = 'purchase' GROUP BY 1")
def _(t):
    hits = ticks(t).filter("event_type = 'purchase'")
    log = J.run_append_log(hits, shared_dir(t.spark, "stream"), "ts")
    return log.groupBy("month").agg(F.count("*").alias("n"))


@query("stream_wilder_state", "sid:i n:i rsi:5 atr:5", """
WITH RECURSIVE r AS (SELECT sid, px, row_number() OVER w AS i, px - lag(px) OVER w AS d FROM ticks WINDOW w AS (PARTITION BY sid ORDER BY ts, event_id)),
s AS (SELECT sid, CAST(15 AS BIGINT) AS i, avg(greatest(d, 0)) AS g, avg(greatest(-d, 0)) AS l, avg(abs(d)) AS a FROM r WHERE i BETWEEN 2 AND 15 GROUP BY sid HAVING count(*) = 14),
x AS (SELECT * FROM s UNION ALL SELECT x.sid, r.i, (x.g * 13 + greatest(r.d, 0)) / 14, (x.l * 13 + greatest(-r.d, 0)) / 14, (x.a * 13 + abs(r.d)) / 14 FROM x JOIN r ON r.sid = x.sid AND r.i = x.i + 1)
SELECT sid, max(i) - 1 AS n, CASE WHEN arg_max(l, i) = 0 THEN 100 ELSE 100 - 100 / (1 + arg_max(g, i) / arg_max(l, i)) END AS rsi, arg_max(a, i) AS atr FROM x GROUP BY sid""")
def _(t):
    own = J.stateful_session(t.spark)
    ticks_there = J.tick_stream(own, t.root, "events.parquet", t.raw("events").schema)
    folder = shared_dir(t.spark, "stream")
    return t.spark.read.parquet(stored(J.latest_of(J.wilder(ticks_there), folder, "sid"), folder))


@query("stream_wilder_in_order", "sid:i n:i rsi:5 atr:5", """
WITH RECURSIVE mx AS (SELECT epoch_ms(max(ts)) - 172800000 AS wm FROM ticks),
r AS (SELECT sid, px, row_number() OVER w AS i, px - lag(px) OVER w AS d FROM ticks, mx WHERE epoch_ms(ts) < wm WINDOW w AS (PARTITION BY sid ORDER BY ts, event_id)),
s AS (SELECT sid, CAST(15 AS BIGINT) AS i, avg(greatest(d, 0)) AS g, avg(greatest(-d, 0)) AS l, avg(abs(d)) AS a FROM r WHERE i BETWEEN 2 AND 15 GROUP BY sid HAVING count(*) = 14),
x AS (SELECT * FROM s UNION ALL SELECT x.sid, r.i, (x.g * 13 + greatest(r.d, 0)) / 14, (x.l * 13 + greatest(-r.d, 0)) / 14, (x.a * 13 + abs(r.d)) / 14 FROM x JOIN r ON r.sid = x.sid AND r.i = x.i + 1)
SELECT sid, max(i) - 1 AS n, CASE WHEN arg_max(l, i) = 0 THEN 100 ELSE 100 - 100 / (1 + arg_max(g, i) / arg_max(l, i)) END AS rsi, arg_max(a, i) AS atr FROM x GROUP BY sid""")
def _(t):
    own = J.stateful_session(t.spark)
    ticks_there = J.tick_stream(own, t.root, "events.parquet", t.raw("events").schema)
    folder = shared_dir(t.spark, "stream")
    return t.spark.read.parquet(stored(J.latest_of(J.wilder_in_order(ticks_there), folder, "sid"), folder))


def stored(df, folder):
    """Writes a result of another session where this one reads it."""
    df.write.parquet(f"{folder}/result")
    return f"{folder}/result"


@query("stream_nav_upsert", "curve:i date:t nav:6 index_nav:6 cdi_nav:6", """
WITH p AS (SELECT sid % 7 AS curve, CAST(ts AS DATE) AS date, event_id AS version, event_type = 'error' AS provisional, CASE WHEN event_type <> 'error' THEN px / 10000 END AS port_ret,
  px / 20000 AS index_ret, CASE WHEN event_type = 'click' THEN 0.0005 END AS cdi_ret FROM ticks),
m AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY curve, date ORDER BY provisional, version DESC) = 1),
k AS (SELECT *, coalesce(cdi_ret, CASE WHEN NOT provisional THEN last_value(cdi_ret IGNORE NULLS) OVER (PARTITION BY curve ORDER BY date) END) AS rate FROM m)
SELECT curve, date, 100 * product(1 + coalesce(port_ret, 0)) OVER w AS nav, 100 * product(1 + coalesce(index_ret, 0)) OVER w AS index_nav, 100 * product(1 + coalesce(rate, 0)) OVER w AS cdi_nav FROM k WINDOW w AS (PARTITION BY curve ORDER BY date)""")
def _(t):
    kind = F.col("event_type")
    points = ticks(t).select(
        (F.col("sid") % 7).alias("curve"), F.to_date("ts").alias("date"), F.col("event_id").alias("version"), (kind == "error").alias("provisional"),
        F.when(kind != "error", F.col("px") / 10000).alias("port_ret"), (F.col("px") / 20000).alias("index_ret"), F.when(kind == "click", 0.0005).alias("cdi_ret"))
    folder = shared_dir(t.spark, "stream")
    start(points, folder).awaitTermination()
    return NavTable(t.spark, f"{folder}/nav").points()
