"""Company filings: statement lines to point-in-time documents.

A document is (issuer, dt_refer). After the lines are aggregated per account, a document holds at
most one row per account of the chart, so windows over a document stay small whatever the number
of issuers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.scalars import code_depth, months_between_rounded, normalize_text
from factorspark.operators import timeseries as ts

DOC = ("issuer", "dt_refer")
FLOWS = ("revenue", "gross_profit", "ebit", "pretax_income", "net_income", "net_income_controlling",
         "operating_cash_flow", "capex", "dna")
# Patterns of account descriptions.
NET_INCOME = r"^lucro.*(?:consolidado|liquido|prejuizo).*do periodo|^lucro/prejuizo do periodo|^lucro ou prejuizo liquido"
CAPEX = r"imobilizado|intangivel|ativo fixo|investimentos em ativos"
NOT_CAPEX = r"venda|alienacao|baixa|recebimento"
DEPRECIATION = r"deprecia|amortiza|exaust"
INSURANCE = r"premios|operacoes de seguro|resseguro"
MAX_STALENESS_DAYS = 500


def normalize_lines(df: DataFrame) -> DataFrame:
    """Order label to cur/prev, descriptions to plain lower case."""
    prev = normalize_text(F.col("ordem")).startswith("pen")
    return df.withColumn("ordem", F.when(prev, "prev").otherwise("cur")).withColumn("ds", normalize_text(F.col("ds")))


def pick_scope(df: DataFrame, keys=(*DOC, "sheet")) -> DataFrame:
    """Consolidated lines; individual ones only where a document has no consolidated line."""
    con = df.filter("scope = 'con'")
    return con.unionByName(df.filter("scope = 'ind'").join(con.select(*keys).distinct(), list(keys), "left_anti"))


def ytd_lines(df: DataFrame) -> DataFrame:
    """Year-to-date lines: those with the earliest start of their document, sheet and order."""
    first = F.min("ini").over(Window.partitionBy(*DOC, "sheet", "ordem"))
    return df.withColumn("_first", first).filter(F.col("ini").isNull() | (F.col("ini") == F.col("_first"))).drop("_first")


def ancestors(code: Column) -> Column:
    """All proper prefixes of a dotted code: ``a.b.c`` gives ``a`` and ``a.b``."""
    parts = F.split(code, r"\.")
    steps = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda k: F.array_join(F.slice(parts, 1, k), "."))


def parent_child(df: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of a line and each line below it. Children carry their ancestors' codes, so this is
    an equality join and not a prefix comparison of all pairs."""
    kids = df.select(*keys, F.col("code").alias("child_code"), F.col("value").alias("child_value"),
                     F.explode(ancestors(F.col("code"))).alias("code"))
    return df.join(kids, [*keys, "code"])


def leaves(df: DataFrame, keys: list[str]) -> DataFrame:
    """Lines without a descendant among the given lines."""
    inner = df.select(*keys, F.explode(ancestors(F.col("code"))).alias("code")).distinct()
    return df.join(inner, [*keys, "code"], "left_anti")


def first_account(cond: Column, value: str = "value") -> Column:
    """Value of the lowest code that meets the condition (an aggregate)."""
    return F.min_by(F.when(cond, F.col(value)), F.when(cond, F.struct("code", "ds")))


def mark_lines(lines: DataFrame) -> DataFrame:
    """Adds what the field rules need to know about a line's document.

    ``ytd``: the line belongs to the year-to-date block. ``ni_code``/``eq_code``: lowest net income
    and equity code, whose children hold the controlling share. ``leaf``: a capex or depreciation
    line without a selected line below it. The lines are partitioned by document once; every
    window and the final aggregate reuse that layout.
    """
    c, ds, depth = F.col("code"), F.col("ds"), code_depth(F.col("code"))
    df = lines.repartition(*DOC)
    block = Window.partitionBy(*DOC, "sheet", "ordem")
    dated = F.col("sheet").isin("DRE", "DFC")
    df = df.withColumn("ytd", dated & F.coalesce(F.col("ini") == F.min("ini").over(block), F.lit(True)))
    dre, dfc = F.col("ytd") & (F.col("sheet") == "DRE"), F.col("ytd") & (F.col("sheet") == "DFC")
    capex = c.startswith("6.02.") & ds.rlike(CAPEX) & ~ds.rlike(NOT_CAPEX) & (F.col("value") < 0)
    dna = c.startswith("6.01.01.") & ds.rlike(DEPRECIATION)
    df = df.withColumn("_pick", F.when(dfc & capex, "x").when(dfc & dna, "d"))
    side = Window.partitionBy(*DOC, "ordem")
    net = F.when(dre & ds.rlike(NET_INCOME) & (depth <= 2), c)
    equity = F.when((F.col("sheet") == "BPP") & (F.col("ordem") == "cur") & ds.rlike("patrimonio liquido") & (depth <= 2), c)
    above = F.when(F.col("_pick").isNotNull(), F.transform(ancestors(c), lambda x: F.concat(F.col("_pick"), x)))
    return (df.withColumn("ni_code", F.min(net).over(side)).withColumn("eq_code", F.min(equity).over(side))
            .withColumn("_above", F.flatten(F.collect_list(above).over(side)))
            .withColumn("leaf", F.when(~F.array_contains("_above", F.concat("_pick", "code")), F.col("_pick")))
            .drop("_above", "_pick"))


def flow_columns(on: Column, suffix: str = "") -> list[Column]:
    """Aggregates of the nine flow fields over the marked lines that satisfy ``on``."""
    c, ds, depth = F.col("code"), F.col("ds"), code_depth(F.col("code"))
    dre, dfc = on & F.col("ytd") & (F.col("sheet") == "DRE"), on & F.col("ytd") & (F.col("sheet") == "DFC")
    below = dre & c.startswith(F.concat(F.col("ni_code"), F.lit("."))) & (depth <= 2)
    net = first_account(dre & ds.rlike(NET_INCOME) & (depth == 1))
    fields = (
        first_account(dre & (c == "3.01")), first_account(dre & ds.rlike("resultado bruto") & (depth == 1)),
        first_account(dre & ds.rlike("^resultado antes do resultado financeiro") & (depth == 1)),
        first_account(dre & ds.rlike("^resultado antes dos tributos") & (depth == 1)), net,
        F.coalesce(first_account(below & ds.rlike("controladora")), net),
        first_account(dfc & (c == "6.01") & ds.rlike("operaciona")),
        F.sum(F.when(on & (F.col("leaf") == "x"), F.col("value"))), F.sum(F.when(on & (F.col("leaf") == "d"), F.col("value"))))
    return [f.alias(name + suffix) for name, f in zip(FLOWS, fields)]


def stock_columns() -> list[Column]:
    """Aggregates of the six balance fields over the marked lines."""
    c, ds, depth = F.col("code"), F.col("ds"), code_depth(F.col("code"))
    cur = F.col("ordem") == "cur"
    a, p = cur & (F.col("sheet") == "BPA"), cur & (F.col("sheet") == "BPP")
    below = p & c.startswith(F.concat(F.col("eq_code"), F.lit("."))) & (depth <= 2)
    equity = first_account(p & ds.rlike("patrimonio liquido") & (depth == 1))
    debt = p & c.rlike(r"^2\.0[12]\.\d\d$") & ds.rlike("^emprestimos e financiamentos")
    return [
        first_account(a & (c == "1")).alias("total_assets"), first_account(a & ds.rlike("^caixa e equivalentes")).alias("cash"),
        first_account(a & c.startswith("1.01.") & ds.rlike("^aplicacoes financeiras") & (depth == 2)).alias("short_term_investments"),
        equity.alias("equity"),
        (equity - F.coalesce(first_account(below & ds.rlike("nao controlador")), F.lit(0.0))).alias("equity_controlling"),
        F.sum(F.when(debt, F.col("value"))).alias("gross_debt")]


def flag_columns() -> list[Column]:
    c, ds, dre = F.col("code"), F.col("ds"), F.col("sheet") == "DRE"
    return [F.bool_or(dre & (c == "3.01") & ds.contains("intermediacao financeira")).alias("is_bank"),
            F.bool_or(dre & (code_depth(c) <= 1) & ds.rlike(INSURANCE)).alias("is_insurer")]


def flows(lines: DataFrame) -> DataFrame:
    """Flow fields per document and order (cur/prev) of normalised, scope-picked lines."""
    rows = mark_lines(lines).filter("ytd")
    return rows.groupBy(*DOC, "ordem").agg(*flow_columns(F.lit(True)))


def stocks(lines: DataFrame) -> DataFrame:
    """Balance fields per document that has a current balance sheet."""
    rows = mark_lines(lines).filter("ordem = 'cur' and sheet in ('BPA', 'BPP')")
    return rows.groupBy(*DOC).agg(*stock_columns())


def issuer_flags(lines: DataFrame) -> DataFrame:
    return lines.filter("sheet = 'DRE'").groupBy(*DOC).agg(*flag_columns())


def documents(lines: DataFrame, form: Column) -> DataFrame:
    """One row per document: year-to-date flows, their comparatives, balances and flags.

    The scope preference is a window here (the same rule as ``pick_scope``), so a document's lines
    are shuffled once and aggregated where they lie.
    """
    df = normalize_lines(lines).repartition(*DOC)
    sheet = Window.partitionBy(*DOC, "sheet")
    df = df.withColumn("_con", F.max((F.col("scope") == "con").cast("int")).over(sheet)).filter("scope = 'con' or _con = 0")
    cur, prev = F.col("ordem") == "cur", F.col("ordem") == "prev"
    docs = mark_lines(df.drop("_con")).groupBy(*DOC).agg(
        *flow_columns(cur, "_ytd"), *flow_columns(prev, "_ytd_prev"), *stock_columns(), *flag_columns(),
        F.min(F.when(cur & F.col("ytd"), F.col("ini"))).alias("fy_start"))
    for col in ("capex_ytd", "dna_ytd", "capex_ytd_prev", "dna_ytd_prev"):
        docs = docs.withColumn(col, F.when(~F.col("is_bank"), F.col(col)))
    return docs.withColumn("form", form).withColumn("ytd_months", months_between_rounded(F.col("fy_start"), F.col("dt_refer")))


def availability(docs: DataFrame, versions: DataFrame) -> DataFrame:
    """Available from the first receipt; documents the index does not list, or of which no version has been received, are dropped."""
    agg = versions.filter("received is not null").groupBy(*DOC, "form").agg(F.min("received").alias("available_from"), F.max("received").alias("last_received"),
                                             F.count_distinct("version").alias("n_versions"))
    return docs.join(agg, [*DOC, "form"])


def add_ttm(docs: DataFrame, fields=FLOWS) -> DataFrame:
    """Trailing twelve months: the annual figure, or year to date + prior annual - prior year to date."""
    last = F.struct("available_from")
    annual = (docs.filter("form = 'DFP'").groupBy("issuer", F.col("dt_refer").alias("_prev_end"))
              .agg(*[F.max_by(f"{f}_ytd", last).alias(f"_{f}_annual") for f in fields]))
    full = (F.col("form") == "DFP") | (F.coalesce("ytd_months", F.lit(0)) == 12)
    out = docs.withColumn("_prev_end", F.date_sub("fy_start", 1)).join(annual, ["issuer", "_prev_end"], "left")
    for f in fields:
        part = F.col(f"{f}_ytd") + F.col(f"_{f}_annual") - F.col(f"{f}_ytd_prev")
        out = out.withColumn(f"{f}_ttm", F.when(full, F.col(f"{f}_ytd")).otherwise(part))
    return out.drop("_prev_end", *[f"_{f}_annual" for f in fields])


def as_of(probes: DataFrame, docs: DataFrame, values: list[str], key: str = "issuer", time: str = "as_of",
          max_staleness_days: int | None = MAX_STALENESS_DAYS) -> DataFrame:
    """Latest document each probe (issuer, as-of date) may know.

    Among those delivered the one with the latest reference date wins, then the latest delivery.
    A running maximum over delivery order finds it: probes and documents of an issuer are sorted
    once, nothing is paired. A later delivery of an older period never replaces a newer one, and
    because the reference date only grows, testing staleness on the winner is exact.
    """
    pcols = probes.columns
    a = probes.select(key, F.col(time).alias("_time"), F.lit(1).alias("_rank"), F.struct(*pcols).alias("_probe"))
    b = docs.select(key, F.col("available_from").alias("_time"), F.lit(0).alias("_rank"),
                    F.struct(F.col("dt_refer"), F.col("available_from"), *[F.col(v) for v in values]).alias("_doc"))
    w = Window.partitionBy(key).orderBy("_time", "_rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = (a.unionByName(b, allowMissingColumns=True).withColumn("_best", F.max("_doc").over(w))
           .filter("_probe is not null and _best is not null"))
    out = hit.select(*[F.col(f"_probe.{c}").alias(c) for c in pcols], "_best.*")
    if max_staleness_days is not None:
        out = out.filter(F.datediff(F.col(time), F.col("dt_refer")) <= max_staleness_days)
    return out


def fix_share_scale(docs: DataFrame, fre: DataFrame) -> DataFrame:
    """Share counts declared in thousands: by the yearly form's total, else by book value per share."""
    yearly = fre.groupBy("issuer", F.year("dt_refer").alias("_year")).agg(F.max_by("shares_total", "dt_refer").alias("fre_total"))
    df = docs.withColumn("_year", F.year("dt_refer")).join(yearly, ["issuer", "_year"], "left")
    ratio, bvps = F.col("fre_total") / F.col("shares_total"), F.col("equity_controlling") / F.col("shares_total")
    by_fre = F.coalesce(ratio.between(300, 3000), F.lit(False))
    by_book = F.col("fre_total").isNull() & F.coalesce(bvps > 1000, F.lit(False))
    scale = F.when(by_fre | by_book, 1000.0).otherwise(1.0)
    return (df.withColumn("shares_scale", F.when(F.col("shares_total").isNotNull(), scale))
            .withColumn("scale_source", F.when(by_fre, "fre").when(by_book, "bvps"))
            .withColumn("shares_total", F.col("shares_total") * scale).drop("_year", "fre_total"))


def shares_as_of(probes: DataFrame, docs: DataFrame, fre: DataFrame, values: list[str]) -> DataFrame:
    """Shares from the statements; the yearly form only where an issuer has none by that date."""
    own = as_of(probes, docs.filter("shares_total is not null"), values, max_staleness_days=None).withColumn("source", F.lit("ITR/DFP"))
    rest = probes.join(own.select(*probes.columns), probes.columns, "left_anti")
    other = as_of(rest, fre, values, max_staleness_days=None).withColumn("source", F.lit("FRE"))
    return own.unionByName(other)


def latest_version(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Values of the row with the highest ``order`` per key, combined map-side."""
    pick = F.max_by(F.struct(*values), F.struct(order))
    return df.groupBy(*keys).agg(pick.alias("_v")).select(*keys, "_v.*")


def issuer_map(tickers: DataFrame, registry: DataFrame, manual: DataFrame, successors: DataFrame) -> DataFrame:
    """Ticker root to issuer code: manual entries beat the registry, which beats the ticker list.

    All inputs: (root, code); ``successors``: (root, heir), where a root inherits its heir's code.
    """
    ranked = (tickers.select("root", "code", F.lit(1).alias("p")).unionByName(registry.select("root", "code", F.lit(2).alias("p")))
              .unionByName(manual.select("root", "code", F.lit(3).alias("p"))))
    base = ranked.groupBy("root").agg(F.max(F.struct("p", "code")).alias("m")).select("root", F.col("m.code").alias("code"))
    heirs = successors.join(base.select(F.col("root").alias("heir"), F.col("code").alias("heir_code")), "heir")
    return (base.join(heirs.select("root", "heir_code"), "root", "full_outer")
            .select("root", F.coalesce("heir_code", "code").alias("code")))


def growth_vs_prior_year(docs: DataFrame, value: str) -> DataFrame:
    """Value against the same issuer's document one year earlier, by an equality join on the date."""
    base = docs.select("issuer", F.add_months("dt_refer", 12).alias("dt_refer"), F.col(value).alias("_base"))
    return docs.join(base, ["issuer", "dt_refer"], "left").withColumn(
        "growth", F.col(value) / F.when(F.col("_base") > 0, F.col("_base")) - 1).drop("_base")


def class_prices(closes: DataFrame) -> DataFrame:
    """Ordinary and preferred price per (date, issuer root); preferred falls back 4, 5, 6."""
    def px(cls):
        return F.max(F.when((F.col("cls") == cls) & (F.col("close") != 0), F.col("close")))

    return closes.groupBy("date", "root").agg(px("3").alias("p_on"), F.coalesce(px("4"), px("5"), px("6")).alias("p_pn"))


def market_cap(on: Column, pn: Column, total: Column, p_on: Column, p_pn: Column, split: Column) -> Column:
    """Ordinary and preferred shares at their prices, adjusted for splits after the document."""
    pref = F.when(pn > 0, pn * F.coalesce(p_pn, p_on)).otherwise(0.0)
    cap = F.when(p_on.isNotNull() & (on > 0), on * p_on + pref).when(p_pn.isNotNull(), total * p_pn)
    return F.when(total.isNotNull(), cap * F.coalesce(split, F.lit(1.0)))


def split_between(events: DataFrame, probes: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Product of the multipliers dated in (start, end] per probe.

    The running product at ``end`` over the one at ``start``: two as-of lookups on the key.
    """
    w = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    daily = events.groupBy(key, "date").agg(F.product("multiplier").alias("m"))
    level = daily.withColumn("_level", F.product("m").over(w)).select(key, "date", "_level")
    a = ts.asof(probes, level, [key], start, "date", ["_level"]).withColumnRenamed("_level", "_from").drop("date_matched")
    b = ts.asof(a, level, [key], end, "date", ["_level"]).drop("date_matched")
    return b.withColumn("split", F.coalesce("_level", F.lit(1.0)) / F.coalesce("_from", F.lit(1.0))).drop("_from", "_level")
