"""Readers with fixed schemas; one job reads a whole folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.functions.scalars import br_date, br_number, code_depth, normalize_text, share_multiplier

# Field positions (1-based, inclusive) of the daily quote record.
QUOTE_FIELDS = {"date": (3, 10), "bdi": (11, 12), "ticker": (13, 24), "market": (25, 27), "name": (28, 39), "spec": (40, 49),
                "open": (57, 69), "high": (70, 82), "low": (83, 95), "avg": (96, 108), "close": (109, 121), "trades": (148, 152),
                "quantity": (153, 170), "volume": (171, 188), "factor": (211, 217), "isin": (231, 242)}
QUOTE_PRICES = ("open", "high", "low", "avg", "close")
SPOT_MARKET, ROUND_LOT = "010", ("02",)

STATEMENT_SCHEMA = ("CD_CVM string, DT_REFER string, VERSAO string, ESCALA_MOEDA string, ORDEM_EXERC string, DT_INI_EXERC string, "
                    "DT_FIM_EXERC string, CD_CONTA string, DS_CONTA string, VL_CONTA string")
INDEX_SCHEMA = "CNPJ_CIA string, DT_REFER string, VERSAO string, DENOM_CIA string, CD_CVM string, DT_RECEB string"
REGISTRY_SCHEMA = "CNPJ_CIA string, DENOM_SOCIAL string, DT_REG string, DT_CANCEL string, SIT string, CD_CVM string, SETOR_ATIV string"
UNIVERSE_SCHEMA = "ticker string, nome string, setor string, subsetor string, inclusion_date date, exclusion_date date"
EVENTS_SCHEMA = ("root string, cash array<struct<typeStock:string, lastDatePriorEx:string, valueCash:string, quotedPerShares:string, "
                 "corporateAction:string>>, stock_events array<struct<label:string, factor:string, isinCode:string, lastDatePrior:string>>")
MEMBERS_SCHEMA = "`index` string, kind string, b3_date date, members array<struct<ticker:string, theoretical_qty:double, weight_pct:double>>"
RECOMMENDATION_SCHEMA = ("date date, mode string, top5 array<struct<ticker:string, score:double, sector:string, entry_price:double>>, "
                         "portfolio_weights map<string,double>, full_universe_scores map<string,map<string,double>>, "
                         "execution_metadata struct<generated_at:timestamp_ntz>")
SCALE = {"MIL": 1000.0, "UNIDADE": 1.0}


def parse_quote_lines(lines: DataFrame, line: str = "value", lots: tuple[str, ...] = ROUND_LOT) -> DataFrame:
    """Positional quote records to daily bars: spot market, round lots; prices per share."""
    def field(name):
        a, b = QUOTE_FIELDS[name]
        return F.substring(line, a, b - a + 1)

    rows = lines.filter((F.substring(line, 1, 2) == "01") & (field("market") == SPOT_MARKET) & field("bdi").isin(*lots))
    factor = F.greatest(field("factor").cast("long"), F.lit(1))
    return rows.select(
        F.to_date(field("date"), "yyyyMMdd").alias("date"), *[F.trim(field(c)).alias(c) for c in ("bdi", "ticker", "name", "isin")],
        F.regexp_replace(F.trim(field("spec")), r"\s+", " ").alias("spec"),
        *[(field(c).cast("long") / 100.0 / factor).alias(c) for c in QUOTE_PRICES],
        field("trades").cast("long").alias("trades"), field("quantity").cast("long").alias("quantity"),
        (field("volume").cast("long") / 100.0).alias("volume"), factor.alias("factor"))


def read_quotes(spark: SparkSession, path: str) -> DataFrame:
    return parse_quote_lines(spark.read.option("encoding", "ISO-8859-1").text(path))


def latest_file(df: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Of rows with the same key the one from the last file wins; combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), source).alias("_r")).select(*keys, "_r.*")


def load_bars(spark: SparkSession, *paths: str) -> DataFrame:
    """Yearly and daily bar files together; a later file replaces an earlier one's bar."""
    df = spark.read.option("basePath", paths[0]).parquet(*paths) if len(paths) == 1 else spark.read.parquet(*paths)
    return latest_file(df.withColumn("_file", F.input_file_name()), ["date", "ticker"], "_file").drop("_file")


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=";", encoding="ISO-8859-1", header=True, mode="PERMISSIVE")


def statement_rows(raw: DataFrame, prefixes: tuple[str, ...] = (), max_depth: int | None = None) -> DataFrame:
    """Raw statement lines to typed ones: order, scaled value, normalised description."""
    scale = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SCALE.items() for x in kv]), F.col("ESCALA_MOEDA")), F.lit(1.0))
    df = raw
    if prefixes:
        keep: Column = F.lit(False)
        for p in prefixes:
            keep = keep | F.col("CD_CONTA").startswith(p)
        df = df.filter(keep)
    if max_depth is not None:
        df = df.filter(code_depth(F.col("CD_CONTA")) <= max_depth)
    return df.select(F.col("CD_CVM").alias("issuer"), F.to_date("DT_REFER").alias("dt_refer"),
                     F.when(normalize_text(F.col("ORDEM_EXERC")).startswith("pen"), "prev").otherwise("cur").alias("ordem"),
                     F.to_date("DT_INI_EXERC").alias("ini"), F.col("CD_CONTA").alias("code"), normalize_text(F.col("DS_CONTA")).alias("ds"),
                     (F.col("VL_CONTA").try_cast("double") * scale).alias("value"))


def read_statements(spark: SparkSession, path: str, prefixes: tuple[str, ...] = (), max_depth: int | None = None) -> DataFrame:
    return statement_rows(_csv(spark, path, STATEMENT_SCHEMA), prefixes, max_depth)


def read_filing_index(spark: SparkSession, path: str, form: str) -> DataFrame:
    """All versions of the filed documents with their receipt dates."""
    return _csv(spark, path, INDEX_SCHEMA).select(
        F.col("CD_CVM").alias("issuer"), F.col("CNPJ_CIA").alias("cnpj"), F.col("DENOM_CIA").alias("name"), F.to_date("DT_REFER").alias("dt_refer"),
        F.col("VERSAO").try_cast("int").alias("version"), F.to_date("DT_RECEB").alias("received"), F.lit(form).alias("form"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Company register; the latest registration of an issuer wins."""
    df = _csv(spark, path, REGISTRY_SCHEMA).select(
        F.lpad("CD_CVM", 6, "0").alias("issuer"), F.col("DENOM_SOCIAL").alias("name"), F.col("SIT").alias("status"),
        F.to_date("DT_REG").alias("registered_on"), F.to_date("DT_CANCEL").alias("canceled_on"), F.col("SETOR_ATIV").alias("sector"))
    rest = [c for c in df.columns if c != "issuer"]
    return df.groupBy("issuer").agg(F.max_by(F.struct(*rest), "registered_on").alias("_r")).select("issuer", "_r.*")


def cash_events(issuers: DataFrame) -> DataFrame:
    """One row per cash event: root, share type, last cum date, value per share, label."""
    e = issuers.select("root", F.explode("cash").alias("e"))
    per = F.coalesce(F.when(br_number(F.col("e.quotedPerShares")) != 0, br_number(F.col("e.quotedPerShares"))), F.lit(1.0))
    return (e.select("root", F.upper(F.trim(F.coalesce("e.typeStock", F.lit("")))).alias("type"), br_date(F.col("e.lastDatePriorEx")).alias("last_date_prior"),
                     (br_number(F.col("e.valueCash")) / F.greatest(per, F.lit(1.0))).alias("value"),
                     F.trim(F.coalesce("e.corporateAction", F.lit(""))).alias("label"))
            .filter("last_date_prior is not null and value > 0"))


def stock_events(issuers: DataFrame) -> DataFrame:
    """Stock events that change the share count: root, isin, last cum date, multiplier."""
    e = issuers.select("root", F.explode("stock_events").alias("e"))
    m = share_multiplier(F.coalesce("e.label", F.lit("")), F.coalesce(br_number(F.col("e.factor")), F.lit(0.0)))
    return (e.select("root", F.trim(F.coalesce("e.isinCode", F.lit(""))).alias("isin"), br_date(F.col("e.lastDatePrior")).alias("last_date_prior"),
                     m.alias("multiplier"), F.trim("e.label").alias("label"))
            .filter("last_date_prior is not null and multiplier > 0 and abs(multiplier - 1) >= 1e-9").distinct())


def read_corporate_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS_SCHEMA).json(path)


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(UNIVERSE_SCHEMA).csv(path, header=True)


def read_index_members(spark: SparkSession, path: str) -> DataFrame:
    """Archived index portfolios, one row per member."""
    df = spark.read.schema(MEMBERS_SCHEMA).json(path)
    return df.select(F.col("index").alias("index_name"), "kind", "b3_date", F.explode("members").alias("m")).select("index_name", "kind", "b3_date", "m.*")


def read_recommendations(spark: SparkSession, path: str, mode: str) -> DataFrame:
    """Stored recommendations of a mode; the folder layout prunes the mode."""
    return spark.read.schema(RECOMMENDATION_SCHEMA).json(path).filter(F.col("mode") == mode)


def long_from_wide(wide: DataFrame, keys: list[str], name: str = "field", value: str = "value") -> DataFrame:
    """Wide table (one column per field or security) to rows without its empty cells."""
    return wide.unpivot(keys, [c for c in wide.columns if c not in keys], name, value).filter(F.col(value).isNotNull())
