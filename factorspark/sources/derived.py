"""Engine tables derived from the star-schema test tables.

Every frame is a lazy plan over the parquet inputs and grows with them: one security per
supplier, one trade print per line item, one filing per order, one tick per event.
``catalog/prelude.py`` states the same derivations in SQL for the result check.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.operators import timeseries as ts
from factorspark.session import cut_lineage


# Chart of accounts the test statements are built from: sheet, code, description, sign.
ACCOUNTS = (
    ("DRE", "3.01", "Receita de Venda de Bens", 1), ("DRE", "3.03", "Resultado Bruto", 1),
    ("DRE", "3.05", "Resultado Antes do Resultado Financeiro", 1), ("DRE", "3.07", "Resultado Antes dos Tributos", 1),
    ("DRE", "3.11", "Lucro/Prejuízo Consolidado do Período", 1), ("DRE", "3.11.01", "Sócios da Empresa Controladora", 1),
    ("DRE", "3.01", "Receitas da Intermediação Financeira", 1), ("DFC", "6.01", "Caixa Líquido Operacional", 1),
    ("DFC", "6.01.01.02", "Depreciação e Amortização", 1), ("DFC", "6.01.01.02.01", "Depreciação de Imóveis", 1),
    ("DFC", "6.02.01", "Aquisição de Imobilizado", -1), ("DFC", "6.02.01.01", "Imobilizado em Andamento", -1),
    ("DFC", "6.02.02", "Venda de Imobilizado", 1), ("BPA", "1", "Ativo Total", 1),
    ("BPA", "1.01.01", "Caixa e Equivalentes de Caixa", 1), ("BPA", "1.01.02", "Aplicações Financeiras", 1),
    ("BPP", "2.03", "Patrimônio Líquido Consolidado", 1), ("BPP", "2.03.09", "Acionistas Não Controladores", 1),
    ("BPP", "2.01.04", "Empréstimos e Financiamentos", 1), ("BPP", "2.02.01", "Empréstimos e Financiamentos", 1),
    ("DRE", "3.02", "Prêmios de Seguros", 1), ("DRE", "3.04", "Despesas Operacionais", -1),
    ("DRE", "3.04.01", "Despesas com Vendas", -1), ("DFC", "6.01.01.03", "Exaustão", 1),
)


class Tables:
    """Reads the raw tables and derives the engine tables from them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def securities(self) -> DataFrame:
        """One row per supplier: ticker, issuer root, share type, sector, subsector, theme."""
        s, n, r = self.raw("supplier"), self.raw("nation"), self.raw("region")
        sid = F.col("s_suppkey")
        kind = F.when(sid % 10 == 9, "DRN").when(sid % 10 == 5, "UNT").when(sid % 2 == 0, "ON").otherwise("PN")
        cls = F.when(sid % 10 == 5, "11").when(sid % 2 == 0, "3").otherwise("4")
        root = F.lpad(F.floor(sid / 2).cast("string"), 6, "0")
        return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
                .select(sid.alias("sid"), F.concat(root, cls).alias("ticker"), root.alias("root"),
                        cls.alias("cls"), kind.alias("kind"), F.col("r_name").alias("sector"),
                        F.col("n_name").alias("subsector"),
                        F.when(F.col("n_regionkey") <= 1, "commodity_export")
                        .when(F.col("n_regionkey") == 2, "financials").otherwise("other").alias("theme"),
                        F.col("s_acctbal").alias("acctbal")))

    @cached_property
    def listings(self) -> DataFrame:
        """Which issuer a ticker stands for and when: it passes to another one, and every third comes back to the first after a gap."""
        s = self.raw("supplier")
        sid = F.col("s_suppkey")
        day = F.date_add(F.lit("1993-07-01").cast("date"), (F.floor(F.abs("s_acctbal")) % 1800).cast("int"))
        none = F.lit(None).cast("date")
        again = sid % 3 == 0

        def span(issuer, start, finish):
            return F.struct(issuer.alias("issuer"), start.alias("start"), finish.alias("finish"))

        spans = F.array(span(sid, none, F.date_sub(day, 1)), span(sid * 3 + 1, day, F.when(again, F.date_add(day, 400))), F.when(again, span(sid, F.date_add(day, 500), none)))
        return s.select(sid.alias("sid"), F.explode(F.filter(spans, lambda x: x.isNotNull())).alias("x")).select("sid", "x.*")

    @cached_property
    def segments(self) -> DataFrame:
        """Line of business of an issuer by year."""
        return self.raw("orders").groupBy(F.col("o_custkey").alias("issuer"), F.year("o_orderdate").alias("year")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("segment"))

    @cached_property
    def trades(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.select(
            F.col("l_suppkey").alias("sid"), F.to_date("l_shipdate").alias("date"),
            F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("seq"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
            F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("value"),
            F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
            F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
            F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("orderkey"))

    @cached_property
    def bars(self) -> DataFrame:
        """Daily bars. The group-by combines prints map-side, so a hot security shuffles one
        partial row per day and task, and no security holds more rows than there are days."""
        return (self.trades.groupBy("sid", "date").agg(
            F.min_by("px", "seq").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
            F.max_by("px", "seq").alias("close"), F.round(F.sum("value"), 2).alias("volume"),
            F.count("*").alias("trades"), F.sum("qty").alias("quantity"),
            F.max(F.when((F.col("flag") == "R") & (F.col("disc") >= 0.09), 2)
                  .when((F.col("flag") == "A") & (F.col("disc") >= 0.1), 1).otherwise(0)).alias("mark")))

    def keep_bars(self, *columns: str) -> Tables:
        """Writes the daily bars out once, for queries with several branches over them; otherwise each branch builds them from the prints.

        ``columns``: what the query reads beside sid and date; what it does not read is neither worked out nor exchanged. Bars that were
        kept with fewer columns are built again.
        """
        kept = self.__dict__.get("_kept", ())
        if not set(columns) <= set(kept):
            columns = tuple(dict.fromkeys((*kept, *columns)))
            self.__dict__.pop("bars", None)
            self.__dict__["_kept"] = columns
            self.__dict__["bars"] = cut_lineage(self.bars.select("sid", "date", *columns))
            for name in ("spec_bars", "sbars", "index_close"):
                self.__dict__.pop(name, None)
        return self

    @cached_property
    def spec_bars(self) -> DataFrame:
        return self.with_spec(self.bars)

    def with_spec(self, bars: DataFrame) -> DataFrame:
        """Bars with ticker, isin and the exchange's specification text."""
        mark = F.when(F.col("mark") == 2, " EB").when(F.col("mark") == 1, " ED").otherwise("")
        return (bars.join(self.securities, "sid")
                .withColumn("spec", F.concat(F.col("kind"), F.when(F.col("sid") % 3 == 0, "*").otherwise(""),
                                             F.lit(" NM"), mark))
                .withColumn("isin", F.concat(F.lit("BR"), F.substring("root", 3, 4), F.lit("AC"),
                                             F.when(F.col("cls") == "3", "NOR").otherwise("NPR"),
                                             F.substring("root", 5, 2)))
                .drop("mark", "acctbal"))

    @cached_property
    def sessions(self) -> DataFrame:
        return ts.sessions(self.trades)

    @cached_property
    def sbars(self) -> DataFrame:
        """Bars with the session ordinal ``sno`` (1-based over the market calendar)."""
        return self.bars.join(self.sessions, "date")

    @cached_property
    def index_close(self) -> DataFrame:
        """The benchmark: mean close of the securities traded in the session."""
        return (self.bars.groupBy("date").agg(F.round(F.avg("close"), 9).alias("close"))
                .join(self.sessions, "date"))

    @cached_property
    def cdi(self) -> DataFrame:
        """Daily policy rate (decimal), from the mean tax rate of the day's prints."""
        return (self.trades.groupBy("date").agg(F.round(F.avg("tax") / 100, 12).alias("cdi"))
                .join(self.sessions, "date"))

    @cached_property
    def cash_events(self) -> DataFrame:
        t = self.trades.filter((F.col("flag") == "R") & (F.col("disc") <= 0.02))
        return (t.join(self.securities.select("sid", "root", "kind"), "sid")
                .select("root", F.col("kind").alias("type"), F.col("date").alias("last_date_prior"),
                        (F.col("px") * F.col("tax") / 10).alias("value"),
                        F.when(F.col("status") == "O", "JRS CAP PROPRIO").otherwise("DIVIDENDO").alias("label"))
                .filter("value > 0"))

    @cached_property
    def stock_events(self) -> DataFrame:
        t = self.trades.filter((F.col("flag") == "A") & (F.col("disc") >= 0.1) & (F.col("tax") >= 0.06))
        mult = F.when(F.col("line") <= 2, 2.0).when(F.col("line") <= 4, 1.1).when(F.col("line") == 5, 0.5).otherwise(0.1)
        return t.select("sid", F.col("date").alias("last_date_prior"), mult.alias("multiplier"))

    @cached_property
    def supplier_x(self) -> DataFrame:
        """Cross-section of all suppliers: sector = nation, so group sizes span all branches."""
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("sid"), F.col("s_nationkey").cast("long").alias("sector"),
            F.col("s_acctbal").alias("value"))

    @cached_property
    def order_docs(self) -> DataFrame:
        """Filed documents: one version per order of a customer and month."""
        o = self.raw("orders")
        ref = F.last_day("o_orderdate")
        return o.select(
            F.col("o_custkey").alias("issuer"), ref.alias("dt_refer"),
            F.when(F.month("o_orderdate") == 12, "DFP").otherwise("ITR").alias("form"),
            F.col("o_orderkey").alias("version"),
            F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 90).cast("int")).alias("received"),
            F.col("o_totalprice").alias("value"))

    @cached_property
    def filings(self) -> DataFrame:
        """PIT filings: available from the first receipt, values of the last version."""
        return self.filings_of(self.order_docs)

    def filings_of(self, docs: DataFrame) -> DataFrame:
        """Filings of the given versions, say those of some issuers only."""
        last = F.struct("version")
        return (docs.groupBy("issuer", "dt_refer", "form").agg(
            F.min("received").alias("available_from"), F.max("received").alias("last_received"),
            F.count_distinct("version").alias("n_versions"),
            F.max_by("value", last).alias("value")))

    @cached_property
    def statement_lines(self) -> DataFrame:
        """Statement lines: ten customers form an issuer, its line items of a quarter one document."""
        o, li = self.raw("orders"), self.raw("lineitem")
        cfg = F.element_at(F.array(*[F.struct(F.lit(s).alias("sheet"), F.lit(c).alias("code"), F.lit(d).alias("ds"),
                                              F.lit(g).alias("sign")) for s, c, d, g in ACCOUNTS]),
                           (F.col("l_partkey") % len(ACCOUNTS) + 1).cast("int"))
        q = F.trunc("o_orderdate", "quarter")
        rows = li.join(o, li.l_orderkey == o.o_orderkey).select(
            F.floor(F.col("o_custkey") / 10).alias("issuer"), F.last_day(F.add_months(q, 2)).alias("dt_refer"),
            cfg.alias("a"), F.when(F.col("l_linestatus") == "O", "con").otherwise("ind").alias("scope"),
            F.when(F.col("l_returnflag") == "R", "PENÚLTIMO").otherwise("ÚLTIMO").alias("ordem"),
            F.when(F.col("l_tax") > 0.05, q).otherwise(F.trunc("o_orderdate", "year")).alias("ini"),
            F.col("l_extendedprice").alias("v"))
        return (rows.groupBy("issuer", "dt_refer", F.col("a.sheet").alias("sheet"), "scope", "ordem", "ini",
                             F.col("a.code").alias("code"), F.col("a.ds").alias("ds"))
                .agg(F.round(F.sum(F.col("v") * F.col("a.sign")), 2).alias("value")))

    @cached_property
    def fundamentals(self) -> DataFrame:
        """One live fundamentals row per security, with gaps and dirty values."""
        sid, a = F.col("sid"), F.col("acctbal")
        pl = F.when(sid % 13 == 0, F.lit(None)).otherwise(a / 250 - 4)
        return (self.securities.select(
            "sid", "ticker", "root", "sector", "subsector", "theme",
            pl.cast("double").alias("pl"),
            F.when(sid % 17 == 0, F.lit(None)).otherwise(0.2 + (sid * 37 % 91) / 20).cast("double").alias("pvp"),
            F.when(sid % 7 == 0, (sid * 53 % 60) / 1.0 + 6).otherwise((sid * 53 % 97) / 100 - 0.3).alias("roe"),
            F.when(sid % 5 == 0, F.lit(None)).otherwise((sid * 29 % 83) / 100 - 0.2).cast("double").alias("roic"),
            F.when(sid % 11 == 0, F.lit(None)).otherwise((sid * 71 % 127) / 10 - 1).cast("double").alias("debt_ebitda"),
            F.when(sid % 4 == 0, (sid * 31 % 25) / 1.0).otherwise((sid * 31 % 25) / 100).alias("dividend_yield"),
            ((sid * 43 % 50) / 10 - 1).alias("beta"),
            ((sid * 97 % 211) * 300000.0 + 1000).alias("adv"),
            (a * 1000000 + 2000000000).alias("market_cap"),
            F.when(sid % 3 == 0, (sid * 19 % 30) / 10).cast("double").alias("fcf_payout"),
            ((sid * 23 % 61) / 100 - 0.2).alias("revenue_growth_3y"),
            ((sid * 67 % 71) / 100 - 0.3).alias("earnings_growth_3y"),
            ((sid * 13 % 41) / 100 - 0.1).alias("asset_growth"),
            F.when(sid % 6 != 0, 1 + (sid * 11 % 40) / 10).cast("double").alias("analyst_score"),
            F.when(sid % 2 == 0, (sid * 17 % 90) / 100 - 0.3).cast("double").alias("target_upside")))

    @cached_property
    def ticks(self) -> DataFrame:
        return self.raw("events").select(
            F.col("user_id").alias("sid"), "ts", "event_id", F.col("value").alias("px"), "event_type")

    @cached_property
    def baskets(self) -> DataFrame:
        """Recommendation baskets: per customer and month the suppliers bought, weight by value.

        Rows are dealt out by basket, which serves the sums by security and whatever is worked out for each basket.
        """
        o, li = self.raw("orders"), self.raw("lineitem")
        rows = li.join(o, li.l_orderkey == o.o_orderkey).select(
            F.col("o_custkey").alias("rec"), F.trunc("o_orderdate", "month").alias("rec_date"),
            F.col("l_suppkey").alias("sid"), F.col("l_extendedprice").alias("value"))
        return rows.repartition("rec", "rec_date").groupBy("rec", "rec_date", "sid").agg(F.round(F.sum("value"), 2).alias("value"))
