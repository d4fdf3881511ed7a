"""Source and sink queries: tables derived from the inputs are written, read back and summarised."""

from pyspark.sql import functions as F

from factorspark.catalog.registry import query
from factorspark.session import shared_dir
from factorspark.sources import readers as R
from factorspark.sources import sinks as S
from factorspark.sources.snapshots import SnapshotTable


def _pad(c, n):
    return F.lpad(c.cast("string"), n, "0")


def quote_lines(t):
    """The bars as positional quote records, every tenth one in another market or lot."""
    def cents(col):
        return _pad(F.round(F.col(col) * 100).cast("long"), 13)

    b = t.spec_bars
    lot = F.when(F.col("sid") % 10 == 3, "96").otherwise("02")
    market = F.when(F.col("sid") % 10 == 4, "020").otherwise("010")
    line = F.concat(
        F.lit("01"), F.date_format("date", "yyyyMMdd"), lot, F.rpad("ticker", 12, " "), market, F.rpad(F.lit("AÇÃO"), 12, " "), F.rpad("spec", 10, " "),
        F.lit(" " * 7), cents("open"), cents("high"), cents("low"), cents("close"), cents("close"), F.lit(" " * 26), _pad(F.col("trades"), 5),
        _pad(F.col("quantity").cast("long"), 18), _pad(F.round(F.col("volume") * 100).cast("long"), 18), F.lit(" " * 22),
        _pad(F.when(F.col("sid") % 6 == 0, 1000).otherwise(1), 7), F.lit(" " * 13), F.rpad("isin", 12, " "), F.lit("   "))
    return b.select(line.alias("value"))


QUOTE_SQL = """SELECT ticker, date, trim(spec) AS spec, round(open * 100) / 100.0 / CASE WHEN sid % 6 = 0 THEN 1000 ELSE 1 END AS open, round(close * 100) / 100.0 / CASE WHEN sid % 6 = 0 THEN 1000 ELSE 1 END AS close,
 volume, trades, CAST(quantity AS BIGINT) AS quantity FROM spec_bars WHERE sid % 10 NOT IN (3, 4)"""


@query("scan_fixed_width_bars", "ticker:s date:t spec:s open:5 close:5 volume:2 trades:i quantity:i", QUOTE_SQL)
def _(t):
    path = shared_dir(t.spark, "quotes")
    lines = quote_lines(t)
    lines.withColumn("year", F.substring("value", 3, 4)).write.partitionBy("year").option("encoding", "ISO-8859-1").text(path)
    return R.read_quotes(t.spark, path)


@query("bars_to_parquet", "year:i n:i volume:2", "SELECT year(date) AS year, count(*) AS n, sum(volume) AS volume FROM spec_bars GROUP BY 1")
def _(t):
    path = shared_dir(t.spark, "bars")
    S.write_bars(t.spec_bars.drop("year"), path)
    return t.spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@query("load_bars_dedup", "ticker:s date:t close:8 volume:2", """
SELECT ticker, date, CASE WHEN date >= DATE '2001-01-01' THEN close + 1 ELSE close END AS close, volume FROM spec_bars""")
def _(t):
    base = shared_dir(t.spark, "files")
    cols = t.spec_bars.select("ticker", "date", "close", "volume")
    cols.filter("date < '2001-07-01'").write.parquet(base + "/a_yearly")
    cols.filter("date >= '2001-01-01'").withColumn("close", F.col("close") + 1).write.parquet(base + "/b_daily")
    return R.load_bars(t.spark, base + "/a_yearly", base + "/b_daily")


@query("scan_statements_csv", "issuer:s dt_refer:t ordem:s code:s ds:s value:2", """
SELECT CAST(issuer AS VARCHAR) AS issuer, dt_refer, CASE WHEN ordem LIKE 'PEN%' OR ordem LIKE 'PEN%' OR ordem = 'PENÚLTIMO' THEN 'prev' ELSE 'cur' END AS ordem, code, lower(strip_accents(ds)) AS ds,
 CASE WHEN issuer % 2 = 0 THEN value * 1000 ELSE value END AS value FROM statement_lines WHERE (starts_with(code, '3.0') OR starts_with(code, '3.11')) AND length(code) - length(replace(code, '.', '')) <= 1""")
def _(t):
    path = shared_dir(t.spark, "statements")
    s = t.statement_lines
    raw = s.select(F.col("issuer").cast("string").alias("CD_CVM"), F.col("dt_refer").cast("string").alias("DT_REFER"), F.lit("1").alias("VERSAO"),
                   F.when(F.col("issuer") % 2 == 0, "MIL").otherwise("UNIDADE").alias("ESCALA_MOEDA"), F.col("ordem").alias("ORDEM_EXERC"),
                   F.col("ini").cast("string").alias("DT_INI_EXERC"), F.col("dt_refer").cast("string").alias("DT_FIM_EXERC"), F.col("code").alias("CD_CONTA"),
                   F.col("ds").alias("DS_CONTA"), F.format_string("%.2f", "value").alias("VL_CONTA"))
    raw.write.csv(path, sep=";", header=True, encoding="ISO-8859-1")
    return R.read_statements(t.spark, path, ("3.0", "3.11"), 1)


@query("scan_filing_index", "issuer:s dt_refer:t version:i received:t form:s", """
SELECT CAST(issuer AS VARCHAR) AS issuer, dt_refer, version, received, form FROM order_docs""")
def _(t):
    path = shared_dir(t.spark, "index")
    t.order_docs.select("form", F.lit("00").alias("CNPJ_CIA"), F.col("dt_refer").alias("DT_REFER"), F.col("version").alias("VERSAO"), F.lit("CIA").alias("DENOM_CIA"),
             F.col("issuer").alias("CD_CVM"), F.col("received").alias("DT_RECEB")).write.partitionBy("form").csv(path, sep=";", header=True, encoding="ISO-8859-1")
    both = [R.read_filing_index(t.spark, f"{path}/form={form}", form) for form in ("DFP", "ITR")]
    return both[0].unionByName(both[1])


@query("scan_registry_csv", "issuer:s name:s status:s registered_on:t", """
SELECT lpad(CAST(c_custkey // 2 AS VARCHAR), 6, '0') AS issuer, arg_max(c_name, c_custkey) AS name, arg_max(c_mktsegment, c_custkey) AS status, max(DATE '1990-01-01' + CAST(c_custkey % 3000 AS INTEGER)) AS registered_on
FROM customer WHERE c_custkey % 3000 >= 0 GROUP BY c_custkey // 2""")
def _(t):
    path = shared_dir(t.spark, "registry")
    c = t.raw("customer")
    c.select(F.lit("0").alias("CNPJ_CIA"), F.col("c_name").alias("DENOM_SOCIAL"), F.date_add(F.lit("1990-01-01").cast("date"), (F.col("c_custkey") % 3000).cast("int")).alias("DT_REG"),
             F.lit(None).cast("date").alias("DT_CANCEL"), F.col("c_mktsegment").alias("SIT"), F.floor(F.col("c_custkey") / 2).alias("CD_CVM"),
             F.lit("x").alias("SETOR_ATIV")).write.csv(path, sep=";", header=True, encoding="ISO-8859-1")
    return R.read_registry(t.spark, path)


@query("scan_corporate_events_json", "root:s kind:s last_date_prior:t value:6 label:s", """
SELECT root, 'cash' AS kind, date AS last_date_prior, value / CASE WHEN line = 1 THEN 1000 ELSE 1 END AS value, 'DIVIDENDO' AS label FROM trades JOIN securities USING (sid) WHERE flag = 'R' AND line <= 2
UNION ALL SELECT DISTINCT root, 'stock', date, CASE WHEN line = 3 THEN 1 + qty / 100 ELSE qty END, CASE WHEN line = 3 THEN 'DESDOBRAMENTO' ELSE 'GRUPAMENTO' END FROM trades JOIN securities USING (sid) WHERE flag = 'A' AND line IN (3, 4) AND NOT (line = 4 AND qty = 1)""")
def _(t):
    path = shared_dir(t.spark, "events")
    tr = t.trades.join(t.securities.select("sid", "root"), "sid")
    day = F.date_format("date", "dd/MM/yyyy")
    price = F.translate(F.format_number("value", 2), ",.", ".,")
    cash = F.struct(F.lit(" on ").alias("typeStock"), day.alias("lastDatePriorEx"), price.alias("valueCash"), F.when(F.col("line") == 1, "1.000").alias("quotedPerShares"), F.lit("DIVIDENDO").alias("corporateAction"))
    stock = F.struct(F.when(F.col("line") == 3, "DESDOBRAMENTO").when(F.col("line") == 4, "GRUPAMENTO").otherwise("INCORPORACAO").alias("label"),
                     F.translate(F.format_number("qty", 2), ",.", ".,").alias("factor"), F.lit("BR").alias("isinCode"), day.alias("lastDatePrior"))
    # one JSON record per issuer and day: a hot issuer spreads over its days
    (tr.groupBy("root", "date").agg(F.collect_list(F.when((F.col("flag") == "R") & (F.col("line") <= 2), cash)).alias("cash"),
                                    F.collect_list(F.when((F.col("flag") == "A") & (F.col("line") >= 3), stock)).alias("stock_events"))
     .drop("date").write.json(path))
    ev = R.read_corporate_events(t.spark, path)
    return (R.cash_events(ev).select("root", F.lit("cash").alias("kind"), "last_date_prior", "value", "label")
            .unionByName(R.stock_events(ev).select("root", F.lit("stock").alias("kind"), "last_date_prior", F.col("multiplier").alias("value"), "label")))


@query("scan_universe_csv", "ticker:s setor:s inclusion_date:t exclusion_date:t", """
SELECT ticker, sector AS setor, min(date) AS inclusion_date, CASE WHEN sid % 4 = 0 THEN max(date) END AS exclusion_date FROM spec_bars GROUP BY ticker, sector, sid""")
def _(t):
    path = shared_dir(t.spark, "universe")
    b = t.spec_bars.groupBy("ticker", "sector", "subsector", "sid").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    b.select("ticker", F.col("ticker").alias("nome"), F.col("sector").alias("setor"), F.col("subsector").alias("subsetor"), F.col("a").alias("inclusion_date"),
             F.when(F.col("sid") % 4 == 0, F.col("b")).alias("exclusion_date")).write.csv(path, header=True)
    return R.read_universe(t.spark, path)


MEM_SQL = "SELECT sector AS index_name, CAST(date_trunc('month', date) AS DATE) AS b3_date, ticker, count(*) AS n FROM spec_bars GROUP BY ALL"


def members(t):
    return t.spec_bars.groupBy(F.col("sector").alias("index_name"), F.trunc("date", "month").alias("b3_date"), "ticker").agg(F.count("*").alias("n"))


@query("scan_index_members_json", "index_name:s b3_date:t ticker:s theoretical_qty:2", f"SELECT index_name, b3_date, ticker, n AS theoretical_qty FROM ({MEM_SQL})")
def _(t):
    path = shared_dir(t.spark, "members")
    m = members(t)
    # a snapshot's members are written in slices, so that a large index is several records
    (m.groupBy(F.col("index_name").alias("index"), F.lit("day").alias("kind"), "b3_date", F.pmod(F.xxhash64("ticker"), F.lit(16)).alias("slice"))
     .agg(F.collect_list(F.struct("ticker", F.col("n").cast("double").alias("theoretical_qty"), F.lit(0.0).alias("weight_pct"))).alias("members"))
     .drop("slice").write.json(path))
    return R.read_index_members(t.spark, path)


@query("sink_on_change", "index_name:s b3_date:t n:i", """
WITH m AS (SELECT sector AS index_name, CAST(date_trunc('month', date) AS DATE) AS b3_date, ticker, TRUE AS big FROM spec_bars GROUP BY ALL),
s AS (SELECT index_name, b3_date, count(*) AS n, string_agg(ticker, ',' ORDER BY ticker) AS sig FROM m WHERE big GROUP BY ALL)
SELECT index_name, b3_date, n FROM s QUALIFY lag(sig) OVER (PARTITION BY index_name ORDER BY b3_date) IS DISTINCT FROM sig""")
def _(t):
    m = members(t).withColumn("qty", F.lit(1.0))
    return S.changed_snapshots(m, "index_name", "b3_date", "ticker", "qty")


@query("long_from_multiindex", "sid:i date:t field:s value:8", """
SELECT sid, date, unnest(['open', 'high', 'low', 'close']) AS field, unnest([open, high, low, close]) AS value FROM bars""")
def _(t):
    return R.long_from_wide(t.bars.select("sid", "date", "open", "high", "low", "close"), ["sid", "date"])


@query("sink_price_snapshot", "sid:i close:8 date:t", "SELECT sid, arg_max(close, date) AS close, max(date) AS date FROM bars WHERE trades < 3 GROUP BY sid")
def _(t):
    path = shared_dir(t.spark, "snapshot")
    S.price_snapshot(t.bars.withColumn("close", F.when(F.col("trades") < 3, F.col("close")))).write.json(path)
    return t.spark.read.schema("sid long, close double, date date").json(path)


@query("sink_universe_snapshot", "sector:s n:i", "SELECT sector, count(*) AS n FROM securities GROUP BY sector")
def _(t):
    path = shared_dir(t.spark, "snapshot")
    S.universe_snapshot(t.securities).write.json(path)
    return t.spark.read.schema("sector string, n long").json(path)


REC_SQL = """
WITH sc AS (SELECT date_trunc('month', date) AS t, sid, ticker, sector, round(50 + 45 * tanh(arg_max(close, date) / arg_min(open, date) - 1), 2) AS score FROM spec_bars GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, sid) AS position FROM sc QUALIFY position <= 5)
"""


@query("sink_recommendation", "t:t position:i ticker:s score:2 w:4 liquidity:4", REC_SQL + "SELECT CAST(t AS DATE) AS t, position, ticker, score, 0.2 AS w, score / 2 AS liquidity FROM p")
def _(t):
    from factorspark.operators.selection import top_n

    ret = F.max_by("close", "date") / F.min_by("open", "date") - 1
    sc = t.spec_bars.groupBy(F.trunc("date", "month").alias("t"), "sid", "ticker", "sector").agg(F.round(50 + 45 * F.tanh(ret), 2).alias("score"))
    picks = top_n(sc, ["t"], "score", 5, out="position")
    scores = sc.select("t", "ticker", F.lit("liquidity").alias("factor"), (F.col("score") / 2).alias("score"))
    rec = S.recommendation_record(picks, picks.select("t", "ticker", F.lit(0.2).alias("w")), scores, ["t"])
    path = shared_dir(t.spark, "records")
    S.overwrite_partitions(rec.withColumn("mode", F.lit("weekly")).withColumn("date", F.col("t")), path, ["mode", "date"], "json")
    schema = ("t date, top array<struct<position:int, ticker:string, score:double, sector:string>>, portfolio_weights map<string,double>, "
              "factor_scores map<string,map<string,double>>, mode string, date date")
    back = t.spark.read.schema(schema).json(path).select("t", "portfolio_weights", "factor_scores", F.explode("top").alias("x"))
    return back.select("t", "x.position", "x.ticker", "x.score", F.try_element_at("portfolio_weights", F.col("x.ticker")).alias("w"),
                       F.try_element_at(F.try_element_at("factor_scores", F.col("x.ticker")), F.lit("liquidity")).alias("liquidity"))


@query("scan_recommendations_json", "date:t ticker:s score:2", REC_SQL + "SELECT CAST(t AS DATE) AS date, ticker, score FROM p WHERE month(t) % 2 = 0")
def _(t):
    from factorspark.operators.selection import top_n

    ret = F.max_by("close", "date") / F.min_by("open", "date") - 1
    sc = t.spec_bars.groupBy(F.trunc("date", "month").alias("date"), "sid", "ticker", "sector").agg(F.round(50 + 45 * F.tanh(ret), 2).alias("score"))
    picks = top_n(sc, ["date"], "score", 5)
    rec = picks.groupBy("date").agg(F.collect_list(F.struct("ticker", "score", "sector", F.lit(1.0).alias("entry_price"))).alias("top5"))
    path = shared_dir(t.spark, "records")
    rec.withColumn("mode", F.when(F.month("date") % 2 == 0, "weekly").otherwise("monthly")).write.partitionBy("mode").json(path)
    return R.read_recommendations(t.spark, path, "weekly").select("date", F.explode("top5").alias("x")).select("date", "x.ticker", "x.score")


@query("sink_partition_overwrite", "month:s n:i volume:2", """
SELECT strftime(date, '%Y-%m') AS month, count(*) AS n, sum(CASE WHEN date >= DATE '2000-01-01' THEN volume * 2 ELSE volume END) AS volume FROM bars GROUP BY 1""")
def _(t):
    path = shared_dir(t.spark, "partitions")
    b = t.bars.select("sid", "date", "volume").withColumn("month", F.date_format("date", "yyyy-MM"))
    table = SnapshotTable(t.spark, path, "sid long, date date, volume double, month string", ["month"])
    table.overwrite(b)
    table.overwrite(b.filter("date >= '2000-01-01'").withColumn("volume", F.col("volume") * 2))
    return table.read().groupBy("month").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@query("sink_append_log", "month:s n:i", "SELECT strftime(date, '%Y-%m') AS month, count(*) * 2 AS n FROM bars GROUP BY 1")
def _(t):
    path = shared_dir(t.spark, "log")
    hits = t.bars.select("sid", "date", "close")
    for _ in range(2):
        S.append_log(hits, path)
    return t.spark.read.schema("sid long, month string").json(path).groupBy("month").agg(F.count("*").alias("n"))
