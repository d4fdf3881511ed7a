"""Sinks: partitioned tables, snapshots, logs. Re-running a partition replaces it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars partitioned by year. Rows meet by year and day first, so a partition gets few files."""
    (bars.withColumn("year", F.year("date")).repartition("year", "date").sortWithinPartitions("ticker", "date")
     .write.mode("overwrite").partitionBy("year").parquet(path))


def overwrite_partitions(df: DataFrame, path: str, by: list[str], fmt: str = "parquet") -> None:
    """Replaces only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(fmt).save(path)


def append_log(records: DataFrame, path: str, date: str = "date") -> None:
    """Appends records to a JSON log partitioned by month."""
    records.withColumn("month", F.date_format(date, "yyyy-MM")).write.mode("append").partitionBy("month").json(path)


def price_snapshot(prices: DataFrame) -> DataFrame:
    """Last known price per security and the session it is from."""
    p = prices.filter("close is not null")
    return p.groupBy("sid").agg(F.max_by("close", "date").alias("close"), F.max("date").alias("date"))


def universe_snapshot(members: DataFrame, by: str = "sector") -> DataFrame:
    return members.groupBy(by).agg(F.count("*").alias("n"))


def recommendation_record(picks: DataFrame, weights: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Nested record per key: ranked picks, weights and the factor scores of the picked names.

    ``picks``: keys, position, ticker, score, sector; ``weights``: keys, ticker, w; ``scores``: keys,
    ticker, factor, score. Every nested list is bounded by the number of picks and factors.
    """
    top = picks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "ticker", "score", "sector"))).alias("top"))
    w = weights.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("ticker", "w"))).alias("portfolio_weights"))
    held = scores.join(picks.select(*keys, "ticker"), [*keys, "ticker"], "left_semi")
    one = held.groupBy(*keys, "ticker").agg(F.map_from_entries(F.collect_list(F.struct("factor", "score"))).alias("s"))
    s = one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("ticker", "s"))).alias("factor_scores"))
    return top.join(w, keys, "left").join(s, keys, "left")


def changed_snapshots(members: DataFrame, key: str, date: str, name: str, qty: str) -> DataFrame:
    """Snapshots whose (name, quantity) set differs from the previous one of the key.

    The signature is a sum of row hashes, so it needs no ordering and combines map-side; two
    independent hashes and the count guard against a coincidence.
    """
    def total(seed):
        return F.sum(F.pmod(F.xxhash64(F.lit(seed), name, qty), F.lit(1 << 40)))

    sig = members.groupBy(key, date).agg(F.struct(F.count("*").alias("n"), total(1).alias("a"), total(2).alias("b")).alias("sig"))
    prev = F.lag("sig").over(Window.partitionBy(key).orderBy(date))
    return sig.withColumn("_p", prev).filter("_p is null or _p <> sig").select(key, date, F.col("sig.n").alias("n"))
