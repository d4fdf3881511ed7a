"""Scalar function queries."""

from pyspark.sql import functions as F

from factorspark.catalog.registry import query
from factorspark.functions import calendar as C
from factorspark.functions import normal as N
from factorspark.functions import scalars as S

EASTER_SQL = """
e0 AS (SELECT DISTINCT year(date) AS y FROM days),
e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM e0),
e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1),
e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS k FROM e2),
e4 AS (SELECT *, (a + 11 * h + 22 * k) // 451 AS m FROM e3),
easter AS (SELECT y, make_date(y, (h + k - 7 * m + 114) // 31, (h + k - 7 * m + 114) % 31 + 1) AS easter FROM e4),
cal AS (SELECT date, isodow(date) < 6 AND NOT (strftime(date, '%m-%d') IN ('01-01','04-21','05-01','09-07','10-12','11-02','11-15','12-24','12-25','12-31')
  OR date - easter IN (-48, -47, -2, 60)) AS trading,
  strftime(date, '%m-%d') IN ('01-01','04-21','05-01','09-07','10-12','11-02','11-15','12-24','12-25','12-31') OR date - easter IN (-48, -47, -2, 60) AS holiday
  FROM days JOIN easter ON y = year(date)),
seq AS (SELECT *, max(CASE WHEN trading THEN date END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_trading,
  max(CASE WHEN trading THEN date END) OVER (ORDER BY date) AS last_trading FROM cal)
"""
DAYS_SQL = "WITH days AS (SELECT CAST(unnest(generate_series(DATE '1994-12-01', DATE '2002-01-01', INTERVAL 1 DAY)) AS DATE) AS date),"


def order_days(t):
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"))


@query("fn_easter", "id:i easter:t", DAYS_SQL + EASTER_SQL + """
SELECT o_orderkey AS id, easter FROM orders JOIN easter ON y = year(o_orderdate)""")
def _(t):
    return order_days(t).select("id", S.easter(F.year("date")).alias("easter"))


@query("fn_holidays", "id:i holiday:b", DAYS_SQL + EASTER_SQL + "SELECT o_orderkey AS id, holiday FROM orders JOIN seq ON date = CAST(o_orderdate AS DATE)")
def _(t):
    return order_days(t).select("id", C.is_holiday(F.col("date")).alias("holiday"))


@query("fn_trading_day", "id:i trading:b prev_trading:t last_trading:t", DAYS_SQL + EASTER_SQL + """
SELECT o_orderkey AS id, trading, prev_trading, last_trading FROM orders JOIN seq ON date = CAST(o_orderdate AS DATE)""")
def _(t):
    return C.with_calendar(order_days(t))


@query("fn_trading_days_between", "id:i n:i", DAYS_SQL + EASTER_SQL + """
SELECT o_orderkey AS id, count_if(trading) AS n FROM orders JOIN seq ON date BETWEEN CAST(o_orderdate AS DATE) AND CAST(o_orderdate AS DATE) + 20 GROUP BY 1""")
def _(t):
    spans = order_days(t).withColumn("end", F.date_add("date", 20))
    return C.trading_days(spans, "date", "end").groupBy("id").agg(F.count("*").alias("n"))


@query("fn_first_session_of_week_month", "id:i weekly_run:b monthly_run:b", DAYS_SQL + EASTER_SQL + """
SELECT o_orderkey AS id, trading AND date_trunc('week', prev_trading) <> date_trunc('week', date) AS weekly_run,
 trading AND date_trunc('month', prev_trading) <> date_trunc('month', date) AS monthly_run FROM orders JOIN seq ON date = CAST(o_orderdate AS DATE)""")
def _(t):
    return C.with_calendar(order_days(t))


@query("fn_normalize_text", "p_partkey:i txt:s", """
SELECT p_partkey, lower(p_name || ' acao ' || p_type || ' orgao') AS txt FROM part""")
def _(t):
    raw = F.concat(F.lit("  "), F.upper("p_name"), F.lit("   AÇÃO "), F.col("p_type"), F.lit(" Órgão™ "))
    return t.raw("part").select("p_partkey", S.normalize_text(raw).alias("txt"))


@query("fn_br_number", "id:i value:2 bad:2", "SELECT o_orderkey AS id, o_totalprice AS value, NULL AS bad FROM orders")
def _(t):
    text = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), S.br_number(text).alias("value"),
                                  S.br_number(F.concat(F.lit("R$ "), text)).alias("bad"))


@query("fn_br_date", "id:i date:t bad:t", "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, NULL AS bad FROM orders")
def _(t):
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), S.br_date(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("date"),
                                  S.br_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("bad"))


@query("fn_share_multiplier", "orderkey:i line:i part:i mult:6", """
SELECT orderkey, line, part, CASE flag WHEN 'A' THEN 1 + qty / 100 WHEN 'N' THEN qty END AS mult FROM trades""")
def _(t):
    label = F.when(F.col("l_returnflag") == "A", "Desdobramento").when(F.col("l_returnflag") == "N", "GRUPAMENTO").otherwise("Incorporacao")
    return t.raw("lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
                                    S.share_multiplier(label, F.col("l_quantity")).alias("mult"))


@query("fn_code_depth", "code:s depth:i n:i", """
SELECT code, length(code) - length(replace(code, '.', '')) AS depth, count(*) AS n FROM (
 SELECT '3.0' || line || CASE WHEN orderkey % 2 = 0 THEN '.' || part % 10 ELSE '' END AS code FROM trades) GROUP BY 1""")
def _(t):
    li = t.raw("lineitem")
    code = F.concat(F.lit("3.0"), F.col("l_linenumber").cast("string"),
                    F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("."), (F.col("l_partkey") % 10).cast("string"))).otherwise(""))
    return li.groupBy(code.alias("code")).agg(F.count("*").alias("n")).withColumn("depth", S.code_depth(F.col("code")))


@query("fn_prefix", "p_partkey:i starts:b", "SELECT p_partkey, starts_with(p_name, 'small') AS starts FROM part")
def _(t):
    return t.raw("part").select("p_partkey", F.col("p_name").startswith("small").alias("starts"))


@query("fn_regex_match", "p_partkey:i hit:b digits:s", """
SELECT p_partkey, regexp_matches(p_name, '^(small|red).*g') AS hit, regexp_extract(p_brand, '#([0-9]+)', 1) AS digits FROM part""")
def _(t):
    return t.raw("part").select("p_partkey", F.col("p_name").rlike("^(small|red).*g").alias("hit"), F.regexp_extract("p_brand", "#([0-9]+)", 1).alias("digits"))


@query("fn_months_between", "id:i months:i", """
SELECT issuer * 1000000 + version AS id, round((received - dt_refer + 400) / 30.44) AS months FROM order_docs""")
def _(t):
    return t.order_docs.select((F.col("issuer") * 1000000 + F.col("version")).alias("id"),
                               S.months_between_rounded(F.col("dt_refer"), F.date_add("received", 400)).alias("months"))


@query("fn_isin_class", "sid:i cls:s n:i", """
SELECT sid, 'AC' || CASE WHEN cls = '3' THEN 'NOR' ELSE 'NPR' END AS cls, count(*) AS n FROM spec_bars GROUP BY ALL""")
def _(t):
    return t.spec_bars.groupBy("sid", S.isin_class(F.col("isin")).alias("cls")).agg(F.count("*").alias("n"))


@query("fn_friction", "sid:i base:8 floor:8", """
SELECT sid, CASE WHEN adv IS NULL OR adv <= 0 THEN 0.0013 ELSE 0.0013 * greatest(1, least(5, sqrt(50000000 / greatest(adv, 1)))) END AS base,
 CASE WHEN adv IS NULL THEN 0.0013 ELSE 0.0013 * greatest(1, least(5, sqrt(50000000 / greatest(adv, 1)))) END AS floor
FROM (SELECT sid, CASE WHEN sid % 10 = 1 THEN NULL WHEN sid % 10 = 2 THEN 0 ELSE adv END AS adv FROM fundamentals)""")
def _(t):
    adv = F.when(F.col("sid") % 10 == 1, F.lit(None)).when(F.col("sid") % 10 == 2, 0.0).otherwise(F.col("adv"))
    df = t.fundamentals.select("sid", adv.alias("adv"))
    return df.select("sid", S.friction(F.col("adv")).alias("base"), S.friction(F.col("adv"), "floor").alias("floor"))


@query("fn_liquidity_penalty", "sid:i penalty:6", """
SELECT sid, coalesce(greatest(0.5, least(1, sqrt(adv / 10000000))), 1) AS penalty FROM fundamentals""")
def _(t):
    return t.fundamentals.select("sid", S.liquidity_penalty(F.col("adv")).alias("penalty"))


def sql_poly(coefs, x):
    out = repr(coefs[0])
    for c in coefs[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def sql_cdf(x: str) -> str:
    a = f"abs({x})"
    near = f"exp(-{a} * {a} / 2) * {sql_poly(N.TAIL_NUM, a)} / {sql_poly(N.TAIL_DEN, a)}"
    tail = f"(CASE WHEN {a} < 7.07106781186547 THEN {near} ELSE 0 END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def sql_ppf(p: str) -> str:
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    mid = f"{q} * {sql_poly(N.PPF_A, r)} / {sql_poly(N.PPF_B, r)}"

    def edge(x):
        s = f"sqrt(-2 * ln({x}))"
        return f"{sql_poly(N.PPF_C, s)} / {sql_poly(N.PPF_D, s)}"

    return (f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < 0.02425 THEN {edge(p)} "
            f"WHEN {p} > 1 - 0.02425 THEN -({edge(f'(1 - {p})')}) ELSE {mid} END)")


@query("fn_norm_cdf", "sid:i p:9", f"SELECT sid, {sql_cdf('z')} AS p FROM (SELECT sid, (acctbal - 4500) / 3000 AS z FROM securities)")
def _(t):
    return t.securities.select("sid", N.norm_cdf((F.col("acctbal") - 4500) / 3000).alias("p"))


@query("fn_norm_ppf", "sid:i z:7", f"SELECT sid, {sql_ppf('p')} AS z FROM (SELECT sid, CAST((acctbal + 1000) / 11000 AS DOUBLE) AS p FROM securities)")
def _(t):
    return t.securities.select("sid", N.norm_ppf((F.col("acctbal") + 1000) / 11000).alias("z"))


@query("fn_round", "sid:i date:t r2:2 r4:4 r6:6", "SELECT sid, date, ln(close) AS r2, ln(close) AS r4, ln(close) AS r6 FROM bars")
def _(t):
    x = F.log("close")
    return t.bars.select("sid", "date", F.round(x, 2).alias("r2"), F.round(x, 4).alias("r4"), F.round(x, 6).alias("r6"))


@query("fn_map_scalars", "rec:i rec_date:t sid:i pct:6", """
SELECT rec, rec_date, sid, value / 1000 AS pct FROM baskets WHERE value > 40000""")
def _(t):
    m = t.baskets.groupBy("rec", "rec_date").agg(F.map_from_entries(F.collect_list(F.struct("sid", "value"))).alias("m"))
    kept = F.transform_values(F.map_filter("m", lambda k, v: v > 40000), lambda k, v: v / 1000)
    return m.select("rec", "rec_date", F.explode(kept).alias("sid", "pct"))


@query("fn_json_scalars", "event_id:i k:i back:s", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"event_id":' || event_id || ',"px":null}' AS back FROM events""")
def _(t):
    e = t.raw("events")
    nan = F.when(F.lit(False), 1.0)  # a missing value serialises as null
    opts = {"ignoreNullFields": "false"}
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"),
                    F.to_json(F.struct("event_id", nan.alias("px")), opts).alias("back"))
