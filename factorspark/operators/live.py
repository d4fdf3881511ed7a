"""Cleaning and derivation of live fundamentals, hard filters, event selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.scalars import normalize_text

MAX_DY = 0.20
MIN_ADV = 5_000_000.0
FUNDAMENTAL_COLUMNS = ("pl", "pvp", "roe", "roic", "debt_ebitda", "dividend_yield")
# Fixed value: suffixes of listed tickers and the security kind they stand for.
SUFFIX_KIND = {"3": "ON", "4": "PN", "5": "PN", "6": "PN", "11": "UNIT"}


def security_kind(text: Column, suffix: Column) -> Column:
    """Kind from the description, else from the ticker's class digits."""
    t = normalize_text(text)
    by_suffix = F.create_map(*[F.lit(x) for kv in SUFFIX_KIND.items() for x in kv])
    return (F.when(t.contains("unit") | t.contains("certificado"), "UNIT").when(t.contains("preferenciais"), "PN")
            .when(t.contains("ordinarias"), "ON").otherwise(F.coalesce(F.try_element_at(by_suffix, suffix), F.lit("OTHER"))))


def cast_and_clean(df: DataFrame) -> DataFrame:
    """Units and anomalies of the live fundamentals; strings lose their nulls."""
    c = F.col

    def percent(col, lo):
        x = F.when(F.abs(c(col)) > 5.0, c(col) / 100).otherwise(c(col))
        return F.when(x >= lo, x)

    dy = F.when(c("dividend_yield") > 1.0, c("dividend_yield") / 100).otherwise(c("dividend_yield"))
    shares = (c("adv") < 1_000_000) & (c("adv") > 0) & (c("price") > 0)
    return (df.withColumn("pl", F.when(c("pl") > 0, c("pl"))).withColumn("roe", percent("roe", -1.0))
            .withColumn("roic", percent("roic", -1.0)).withColumn("dividend_yield", F.when(dy <= MAX_DY, dy))
            .withColumn("adv", F.when(shares, c("adv") * c("price")).otherwise(c("adv")))
            .fillna("", [n for n, t in df.dtypes if t == "string"]))


def derive_metrics(df: DataFrame) -> DataFrame:
    c = F.col
    return (df.withColumn("earnings_yield", F.when(c("pl") > 0, 1 / c("pl")))
            .withColumn("log_market_cap", F.when(c("market_cap") > 0, F.log10("market_cap")))
            .withColumn("roe", F.when(c("roe").between(-1.0, 1.5), c("roe")))
            .withColumn("roic", F.when(c("roic").between(-1.0, 1.5), c("roic")))
            .withColumn("debt_ebitda", F.when(F.abs("debt_ebitda") <= 50, c("debt_ebitda"))))


def merge_sources(primary: DataFrame, secondary: DataFrame, key: str, fields: list[str],
                  names: tuple[str, str]) -> DataFrame:
    """Per field the primary value, else the secondary; ``data_source`` names who answered."""
    a = primary.select(key, F.lit(True).alias("_a"), *[F.col(f).alias(f"a_{f}") for f in fields])
    b = secondary.select(key, F.lit(True).alias("_b"), *[F.col(f).alias(f"b_{f}") for f in fields])
    label = F.concat_ws("+", F.when(F.col("_a"), names[0]), F.when(F.col("_b"), names[1]))
    return a.join(b, key, "full_outer").select(
        key, *[F.coalesce(f"a_{f}", f"b_{f}").alias(f) for f in fields],
        F.when(label == "", "failed").otherwise(label).alias("data_source"))


def derive_quote_ratios(df: DataFrame) -> DataFrame:
    """Zeros to null, total debt over EBITDA, return on assets and forward P/L as fallbacks."""
    def val(col):
        return F.when(F.col(col) != 0, F.col(col))

    fwd = F.when((val("forward_pl") > 0) & (val("forward_pl") < 80), val("forward_pl"))
    return (df.withColumn("debt_ebitda", val("total_debt") / val("ebitda"))
            .withColumn("roic", F.coalesce(val("roic"), val("roa"))).withColumn("pl", F.coalesce(val("pl"), fwd)))


def parse_quote_fields(df: DataFrame) -> DataFrame:
    """A raw quote record to engine names; percent yields become fractions."""
    q = F.col("quote")
    dy = q["dividendYield"]
    return df.select(
        "sid", q["regularMarketPrice"].alias("current_price"), q["priceEarningsRatio"].alias("pl"),
        F.when(dy > 1.0, dy / 100).otherwise(dy).alias("dividend_yield"),
        F.coalesce(F.when(q["averageDailyVolume3Month"] != 0, q["averageDailyVolume3Month"]),
                   q["regularMarketVolume"]).alias("adv"), q["marketCap"].alias("market_cap"))


def latest_past_event(events: DataFrame, as_of: Column, key: str = "sid") -> DataFrame:
    """Most recent event strictly before the as-of date; surprises above 1 are percentages."""
    past = events.filter(F.col("event_date") < as_of)
    last = past.groupBy(key).agg(F.max(F.struct("event_date", "surprise")).alias("e"))
    s = F.col("e.surprise")
    return last.select(key, F.col("e.event_date").alias("event_date"), F.datediff(as_of, F.col("e.event_date")).alias("days_since"),
                       F.when(F.abs(s) > 1, s / 100).otherwise(s).alias("surprise"))


def liquid(df: DataFrame, min_adv: float = MIN_ADV) -> DataFrame:
    """Unknown volume stays."""
    return df.filter(F.col("adv").isNull() | (F.col("adv") >= min_adv))


def not_overlevered(df: DataFrame, financial: Column, soft: float = 5.0, hard: float = 10.0,
                    tolerance: float = 1.5) -> DataFrame:
    """Sector-relative leverage filter; financials pass."""
    med = (df.filter(~financial & F.col("debt_ebitda").isNotNull()).groupBy("sector")
           .agg(F.percentile("debt_ebitda", 0.5).alias("_med")))
    d = F.col("debt_ebitda")
    over = (d > hard) | ((d > soft) & (d > F.col("_med") * tolerance))
    return df.join(med, "sector", "left").filter(financial | ~F.coalesce(over, F.lit(False))).drop("_med")


def flat_leverage(df: DataFrame, financial: Column, limit: float = 5.0) -> DataFrame:
    """The study's rule: one limit for all non-financials."""
    return df.filter(financial | ~F.coalesce(F.col("debt_ebitda") > limit, F.lit(False)))


def no_value_trap(df: DataFrame) -> DataFrame:
    trap = (F.col("pl") < 0) & (F.col("roe") < -0.05)
    return df.filter(~F.coalesce(trap, F.lit(False)))


def n_fundamentals() -> Column:
    return sum(F.col(c).isNotNull().cast("int") for c in FUNDAMENTAL_COLUMNS)


def enough_fundamentals(df: DataFrame, financial: Column, required: int = 3) -> DataFrame:
    n = n_fundamentals()
    return df.filter((n >= required) | (financial & (n >= required - 1)))


def hard_filters(df: DataFrame, financial: Column) -> DataFrame:
    """All live filters in order."""
    return enough_fundamentals(no_value_trap(not_overlevered(liquid(df), financial)), financial)


def stale_prices(bars: DataFrame, last_sno: DataFrame, max_lag: int = 3, run: int = 5, run_low: int = 10,
                 low_price: float = 2.0) -> DataFrame:
    """Securities whose price lags the panel or has not moved in its last rows.

    ``bars``: sid, sno, close; ``last_sno``: one row with the panel's last ordinal.
    """
    w = Window.partitionBy("sid").orderBy(F.col("sno").desc())
    tail = bars.filter("close is not null").withColumn("j", F.row_number().over(w)).filter(F.col("j") <= max(run, run_low))
    j, c = F.col("j"), F.col("close")

    def spread(k):
        inside = F.when(j <= k, c)
        return F.max(inside) - F.min(inside)

    g = tail.groupBy("sid").agg(F.max("sno").alias("own"), F.max(F.when(j == 1, c)).alias("last"), F.count("*").alias("n"),
                                spread(run).alias("s1"), spread(run_low).alias("s2")).join(F.broadcast(last_sno))
    lag = F.col("last_sno") - F.col("own")
    low = F.col("last") < low_price
    need, gap = F.when(low, run_low).otherwise(run), F.when(low, F.col("s2")).otherwise(F.col("s1"))
    frozen = (F.col("n") >= need) & (gap <= 1e-6 * F.abs("last"))
    return (g.withColumn("lag", lag).withColumn("reason", F.when(lag > max_lag, "lag").when(frozen, "frozen"))
            .filter("reason is not null").select("sid", "lag", "reason"))


def drop_stale(df: DataFrame, stale: DataFrame) -> DataFrame:
    return df.join(stale.select("sid"), "sid", "left_anti")


def keep_spaced(records: DataFrame, key: str, date: str, min_gap: int = 2) -> DataFrame:
    """Chronological records without those at most ``min_gap`` days after the last kept one.

    The rule compares with the last *kept* record, so it folds each key's distinct dates in order;
    a key has at most one entry per calendar day.
    """
    dates = records.groupBy(key, date).agg(F.lit(1)).groupBy(key).agg(F.array_sort(F.collect_list(date)).alias("d"))
    kept = F.aggregate("d", F.array().cast("array<date>"), lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.datediff(x, F.element_at(acc, -1)) <= min_gap), acc).otherwise(F.concat(acc, F.array(x))))
    # try_element_at would also do; element_at is only evaluated on non-empty lists
    return dates.select(key, F.explode(kept).alias(date))


def cagr3(now: Column, then: Column) -> Column:
    """Three-year compound growth within [-100%, +500%]; the base must be positive."""
    g = F.pow(F.greatest(now, F.lit(0.0)) / F.when(then > 0, then), F.lit(1 / 3)) - 1
    return F.when(g.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(5.0), g)))


def analyst_score(counts: dict[int, Column]) -> Column:
    """Mean vote 1 to 5 weighted by how many analysts gave it."""
    total = sum(counts.values())
    return sum(v * n for v, n in counts.items()) / F.when(total > 0, total)
