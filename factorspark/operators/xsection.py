"""Cross-section operators: ranks, quantiles, winsorising, z-scores, quintiles.

A cross-section (one date, or one date and factor) grows with the number of securities and may
hold most of the data, so nothing here collects a cross-section into one task. Moments are
aggregates combined map-side and joined back. Ranks and medians come from a histogram of distinct
values split into ordered chunks: ranks inside a chunk plus the counts of the chunks before it.
Every operator takes at least one key column (a date, or a constant for a single cross-section).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorspark.functions.normal import norm_ppf
from factorspark.session import cut_lineage

CHUNKS_PER_E_FOLD = 4096
#: Chunks of an id-like value, and the distinct rows whose values cut them.
CHUNKS, SAMPLE = 1024, 65_536
MIN_SECTOR_Z, MIN_SECTOR_PCT, MIN_WINSOR = 8, 4, 5
MAD_SCALE = 1.4826


def chunked(hist: DataFrame, value: str, chunks: int = CHUNKS, sample: int = SAMPLE) -> DataFrame:
    """Adds ``_chunk``, an order-preserving chunk of a column, to a histogram. A recomputed task assigns the same one.

    Text and whole numbers, which may share a prefix or lie close together far from zero, are cut at quantiles of
    a sample: the rows with the smallest hashes, which is the same sample whatever order tasks finish in, and uniform over
    the histogram, so a key with a third of its rows has a third of the sample. It is one row of at most ``chunks`` split points.
    Other numbers have a fixed logarithmic scale, linear around zero, on which a chunk spans a quarter per mille of
    the value, so heavy-tailed values spread over tasks without a sample. Dates: the day.
    """
    kind, v = hist.schema[value].dataType, F.col(value)
    if isinstance(kind, T.DateType):
        return hist.withColumn("_chunk", F.unix_date(v))
    if not isinstance(kind, (T.StringType, T.IntegralType)):
        v = v.cast("double")
        return hist.withColumn("_chunk", F.floor(F.signum(v) * F.log1p(F.abs(v) * 1e6) * CHUNKS_PER_E_FOLD))
    keys = [c for c in hist.columns if c not in (value, "m")]
    picked = hist.select(F.xxhash64(*keys, value).alias("_h"), v.alias("_v")).orderBy("_h", "_v").limit(sample)
    sorted_ = picked.agg(F.array_sort(F.collect_list("_v")).alias("_s"))
    nth = F.transform(F.sequence(F.lit(1), F.lit(chunks - 1)), lambda i: F.get("_s", F.floor(i * F.size("_s") / chunks).cast("int")))
    splits = sorted_.select(F.array_sort(F.array_distinct(F.array_compact(nth))).alias("_splits"))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range((chunks - 1).bit_length()))])
    # number of split points up to the value, by halving
    at = F.aggregate(steps, F.lit(0), lambda done, step: F.when(F.get("_splits", done + step - 1) <= v, done + step).otherwise(done))
    return hist.crossJoin(F.broadcast(splits)).withColumn("_chunk", at).drop("_splits")


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values per key with their number of rows ``m`` (combined map-side); null and NaN are no values."""
    there = F.col(value).isNotNull()
    if isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType)):
        there = there & ~F.isnan(value)
    return df.filter(there).groupBy(*keys, value).agg(F.count("*").alias("m"))


def ranked(hist: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds to a histogram ``below`` (rows smaller) and ``n`` (rows in all)."""
    inside = Window.partitionBy(*keys, "_chunk").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    cut = chunked(hist, value).withColumn("_in", F.coalesce(F.sum("m").over(inside), F.lit(0)))
    tot = cut.groupBy(*keys, "_chunk").agg(F.sum("m").alias("_t"))
    part = Window.partitionBy(*keys)
    before = part.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("_off", F.coalesce(F.sum("_t").over(before), F.lit(0))).withColumn("n", F.sum("_t").over(part)).drop("_t")
    return cut.join(tot, [*keys, "_chunk"]).withColumn("below", F.col("_off") + F.col("_in")).drop("_chunk", "_in", "_off")


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key and distinct value: ``below`` (rows smaller), ``m`` (rows equal), ``n`` (rows in all)."""
    return ranked(histogram(df, keys, value), keys, value)


def with_average_rank(df: DataFrame, keys: list[str], value: str, out: str = "rank", count: str | None = None) -> DataFrame:
    """Rank with ties averaged; null values get no rank."""
    r = value_ranks(df, keys, value)
    cols = [*keys, value, average_rank().alias(out)]
    if count:
        cols.append(F.col("n").alias(count))
    return df.join(r.select(*cols), [*keys, value], "left")


def average_rank() -> Column:
    """Average rank of a ranked histogram row."""
    return F.col("below") + (F.col("m") + 1) / 2


def with_first_rank(df: DataFrame, keys: list[str], value: str, tie: str, out: str = "rank", count: str = "n") -> DataFrame:
    """Row number by value, then by ``tie``. Ties are ranked by the same chunked scheme one level
    down, so even a single value shared by all rows is spread over tasks."""
    r = value_ranks(df, keys, value).select(*keys, value, "below", F.col("n").alias(count))
    t = value_ranks(df.filter(F.col(value).isNotNull()), [*keys, value], tie).select(*keys, value, tie, F.col("below").alias("_tb"))
    return (df.join(r, [*keys, value], "left").join(t, [*keys, value, tie], "left")
            .withColumn(out, F.col("below") + F.col("_tb") + 1).drop("below", "_tb"))


def quantiles_of(r: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear interpolation) of a ranked histogram, one column per ``probs`` entry."""
    aggs = []
    for name, p in probs.items():
        pos = 1 + p * (F.col("n") - 1)
        for tag, k in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            here = (F.col("below") < k) & (k <= F.col("below") + F.col("m"))
            aggs.append(F.max(F.when(here, F.col(value))).alias(f"_{name}_{tag}"))
    out = r.groupBy(*keys).agg(F.max("n").alias("_n"), *aggs)
    cols = []
    for name, p in probs.items():
        pos = 1 + p * (F.col("_n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (pos - F.floor(pos)) * (hi - lo)).alias(name))
    return out.select(*keys, *cols)


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    return quantiles_of(value_ranks(df, keys, value), keys, value, probs)


def medians(df: DataFrame, keys: list[str], value: str, out: str = "med") -> DataFrame:
    return quantiles(df, keys, value, {out: 0.5})


def with_mad(r: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``med`` and the scaled ``mad`` of each key to its ranked histogram.

    Its own medians share the histogram's exchange. The result feeds every later statistic, so it is
    written to the shared folder once: planned anew for each reader, the plans of a composite score multiply.
    """
    r = r.join(quantiles_of(r, keys, value, {"med": 0.5}), keys).withColumn("_dev", F.abs(F.col(value) - F.col("med")))
    dev = r.groupBy(*keys, "_dev").agg(F.sum("m").alias("m"))
    mad = quantiles_of(ranked(dev, keys, "_dev"), keys, "_dev", {"mad": 0.5})
    return cut_lineage(r.drop("_dev").join(mad.withColumn("mad", F.col("mad") * MAD_SCALE), keys))


def winsorized(value: Column, k: float, apply: Column | None = None) -> Column:
    """Value within ``med`` ± k·``mad``; unchanged where the mad is zero."""
    use = F.col("mad") > 0
    cut = F.greatest(F.col("med") - k * F.col("mad"), F.least(F.col("med") + k * F.col("mad"), value))
    return F.when(use if apply is None else use & apply, cut).otherwise(value)


def hist_moments(r: DataFrame, keys: list[str], value: str, prefix: str, center: str = "med") -> DataFrame:
    """Count, mean and sample deviation of a histogram's values, summed around ``center``."""
    d = F.col(value) - F.col(center)
    g = r.groupBy(*keys).agg(F.sum("m").alias("_c"), F.sum(F.col("m") * d).alias("_s"), F.sum(F.col("m") * d * d).alias("_q"),
                             F.max(center).alias("_o"))
    c, s, q = F.col("_c"), F.col("_s"), F.col("_q")
    var = F.greatest((q - s * s / c) / F.when(c > 1, c - 1), F.lit(0.0))
    return g.select(*keys, c.alias(f"{prefix}_n"), (F.col("_o") + s / c).alias(f"{prefix}_mean"),
                    F.when(c > 1, F.sqrt(var)).alias(f"{prefix}_std"))


def _join(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Group statistics back to the rows. Statistics have one row per group; AQE broadcasts them
    when their measured size allows and splits skewed groups when it does not."""
    return df.join(stats, keys, "left")


def moments(df: DataFrame, keys: list[str], value: str, prefix: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias(f"{prefix}_n"), F.avg(value).alias(f"{prefix}_mean"),
                                 F.stddev_samp(value).alias(f"{prefix}_std"))


def mad_winsor(df: DataFrame, keys: list[str], value: str, k: float = 5.0, out: str = "w") -> DataFrame:
    """Clips to the median ± k scaled median absolute deviations of the key."""
    r = with_mad(value_ranks(df, keys, value), keys, value)
    return _join(df, r.select(*keys, value, winsorized(F.col(value), k).alias(out)), [*keys, value])


def _clip3(z: Column) -> Column:
    return F.when(z.isNotNull(), F.greatest(F.lit(-3.0), F.least(F.lit(3.0), z)))


def _z(x: str, prefix: str) -> Column:
    """Clipped z of a value; 0 where the group has no spread."""
    std = F.col(f"{prefix}_std")
    return F.when(std == 0, 0.0).otherwise(_clip3((F.col(x) - F.col(f"{prefix}_mean")) / std))


def _score(z: Column) -> Column:
    return (z + 3.0) / 6.0 * 100.0


def normalize_global(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Live global rule: z over all values, clipped to ±3, mapped to 0..100. Adds method, n_peers, z, pct, score."""
    df = _join(df, moments(df, keys, value, "_g"), keys)
    ok = F.col("_g_n") >= 2
    return (df.withColumn("method", F.when(ok, "zscore_global")).withColumn("n_peers", F.when(ok, F.col("_g_n")))
            .withColumn("z", F.when(ok & F.col(value).isNotNull(), _z(value, "_g"))).withColumn("pct", F.lit(None).cast("double"))
            .withColumn("score", _score(F.col("z"))).drop("_g_n", "_g_mean", "_g_std"))


def normalize_adaptive(df: DataFrame, keys: list[str], sector: str, value: str, k: float = 3.0) -> DataFrame:
    """Live sector rule by the number of peers with a value.

    At least 8: winsorised sector z; 4 to 7: sector percentile; fewer: z over all sectors. All of
    it is a function of group and value, so it is worked out on the histogram of distinct values;
    the rows are read to build that and joined to it once.
    """
    by = [*keys, sector]
    r = with_mad(value_ranks(df, by, value), by, value)
    r = r.withColumn("_w", winsorized(F.col(value), k, F.col("n") >= MIN_WINSOR))
    r = r.join(hist_moments(r, by, "_w", "_s"), by)
    r = r.join(moments(df, keys, value, "_g"), keys)
    big, mid, n_all = F.col("n") >= MIN_SECTOR_Z, F.col("n") >= MIN_SECTOR_PCT, F.col("_g_n")
    r = (r.withColumn("pct", F.when(~big & mid, 100 * average_rank() / F.col("n")))
         .withColumn("z", F.when(big, _z("_w", "_s")).when(~mid & (n_all >= 2), _z(value, "_g")))
         .withColumn("score", F.coalesce("pct", _score(F.col("z")))))
    # rows without a value still report how their group is normalised
    n = df.groupBy(*by).agg(F.count(value).alias("_n"))
    group = n.withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    gn, ga = F.col("_n"), F.col("_all")
    group = group.select(
        *by, F.when(gn >= MIN_SECTOR_Z, "zscore_sectoral").when(gn >= MIN_SECTOR_PCT, "percentile_sectoral")
        .when(ga >= 2, "zscore_global").alias("method"), F.when(gn >= MIN_SECTOR_PCT, gn).when(ga >= 2, ga).alias("n_peers"))
    return _join(_join(df, group, by), r.select(*by, value, "z", "pct", "score"), [*by, value])


def sector_adaptive_z(df: DataFrame, keys: list[str], sector: str, value: str, direction: str, out: str = "z") -> DataFrame:
    """Study sector rule: winsorise the whole cross-section, then sector z (8 or more), normal
    score of the sector rank (4 to 7, or a sector without spread), or global z; clipped to ±3.

    ``direction`` names a column of +1/-1 that is constant within a key.
    """
    x = mad_winsor(df, keys, value, 5.0, "_w").withColumn("_x", F.col("_w") * F.col(direction)).drop("_w")
    by = [*keys, sector]
    r = value_ranks(x, by, "_x")
    r = r.join(moments(x, by, "_x", "_s"), by).join(moments(x, keys, "_x", "_g"), keys)
    n = F.col("n")
    z = (F.when((n >= MIN_SECTOR_Z) & (F.col("_s_std") > 0), (F.col("_x") - F.col("_s_mean")) / F.col("_s_std"))
         .when(n >= MIN_SECTOR_PCT, norm_ppf((average_rank() - 0.5) / n))
         .when(F.col("_g_std") > 0, (F.col("_x") - F.col("_g_mean")) / F.col("_g_std")))
    return _join(x, r.select(*by, "_x", _clip3(z).alias(out)), [*by, "_x"]).drop("_x")


def global_z(df: DataFrame, keys: list[str], value: str, direction: str | None = None, out: str = "z") -> DataFrame:
    """Study global rule: winsorised z over the whole cross-section, clipped to ±3."""
    r = with_mad(value_ranks(df, keys, value), keys, value).withColumn("_w", winsorized(F.col(value), 5.0))
    r = r.join(hist_moments(r, keys, "_w", "_g"), keys)
    z = _clip3((F.col("_w") - F.col("_g_mean")) / F.when(F.col("_g_std") > 0, F.col("_g_std")))
    joined = _join(df, r.select(*keys, value, z.alias(out)), [*keys, value])
    return joined if direction is None else joined.withColumn(out, F.col(out) * F.col(direction))


def sector_neutral(df: DataFrame, keys: list[str], sector: str, value: str, out: str = "neutral") -> DataFrame:
    """Percentile rank minus the sector's mean percentile rank."""
    r = with_average_rank(df, keys, value, "_rank", "_n").withColumn("_p", F.col("_rank") / F.col("_n"))
    mean = r.groupBy(*keys, sector).agg(F.avg("_p").alias("_m"))
    return _join(r, mean, [*keys, sector]).withColumn(out, F.col("_p") - F.col("_m")).drop("_rank", "_n", "_p", "_m")


def quantile_bucket(rank: Column, n: Column, q: int = 5) -> Column:
    """Bucket 1..q of a first-rank, cut at evenly spaced ranks with interpolation; null without a rank."""
    return F.when(rank.isNotNull(), F.greatest(F.lit(1), F.ceil(q * (rank - 1) / F.when(n > 1, n - 1)))).cast("int")


def quintiles(df: DataFrame, keys: list[str], value: str, tie: str, q: int = 5, out: str = "bucket") -> DataFrame:
    """Quantile bucket of each value; null when fewer than 3·q values exist."""
    r = with_first_rank(df, keys, value, tie, "_rank", "_n")
    return r.withColumn(out, F.when(F.col("_n") >= 3 * q, quantile_bucket(F.col("_rank"), F.col("_n"), q))).drop("_rank", "_n")
