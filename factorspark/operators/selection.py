"""Selection: top-k, turnover band, constrained diverse portfolio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: list[str], score: str, n: int, tie: str = "sid", out: str = "rank") -> DataFrame:
    """Best ``n`` rows per key. Spark applies the rank limit per task before shuffling, so a large
    cross-section ships at most ``n`` rows per task."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), tie)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def turnover_band(df: DataFrame, incumbents: DataFrame, keys: list[str], points: float = 5.0) -> DataFrame:
    """Adds ``points`` to holdings with a score of at least 50 (column ``adjusted``)."""
    held = incumbents.select(*keys, "sid").distinct().withColumn("_held", F.lit(True))
    bonus = F.when(F.col("_held") & (F.col("score") >= 50), points).otherwise(0.0)
    return df.join(held, [*keys, "sid"], "left").withColumn("adjusted", F.col("score") + bonus).drop("_held")


def _candidates(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """A set that provably contains every row the greedy selection can pick.

    Caps only tighten while picking, so of rows equal in company, sector, subsector and theme only
    the best can be picked. Within one sector, subsector and theme at most ``n`` are picked and at most ``n``
    companies are already taken elsewhere, so the best ``2n`` suffice. The unconstrained last step
    takes rows not yet picked from the overall top ``2n``. Sizes no longer depend on the number of
    securities.
    """
    order = [F.col("score").desc_nulls_last(), F.col("sid")]
    one = Window.partitionBy(*keys, "sector", "subsector", "theme", "company").orderBy(*order)
    some = Window.partitionBy(*keys, "sector", "subsector", "theme").orderBy(*order)
    best = (df.withColumn("_r", F.row_number().over(one)).filter("_r = 1")
            .withColumn("_r", F.row_number().over(some)).filter(F.col("_r") <= 2 * n).drop("_r"))
    over = top_n(df, keys, "score", 2 * n, out="_r").drop("_r")
    return best.unionByName(over).dropDuplicates([*keys, "sid"])


def _greedy(rows: Column, n: int, caps: dict, min_score: float | None, subsector: bool) -> Column:
    """Folds the ordered rows to the picked ones under the caps."""
    empty = F.filter(rows, lambda r: F.lit(False))

    def count(sel, field, r):
        return F.size(F.filter(sel, lambda s: s[field] == r[field]))

    def step(sel, r):
        ok = (F.size(sel) < n) & (count(sel, "company", r) == 0) & (count(sel, "sector", r) < caps["sector"]) & (
            count(sel, "theme", r) < caps["theme"])
        if min_score is not None:
            ok = ok & (F.coalesce(r["score"], F.lit(0.0)) >= min_score)
        if subsector:
            ok = ok & ((r["subsector"] == "") | (count(sel, "subsector", r) < caps["subsector"]))
        return F.when(ok, F.concat(sel, F.array(r))).otherwise(sel)

    return F.aggregate(rows, empty, step)


def select_diverse(df: DataFrame, keys: list[str], n: int = 5, max_sector: int = 2, max_subsector: int = 1,
                   max_theme: int = 2, min_score: float = 50.0) -> DataFrame:
    """Greedy top ``n`` per key with one name per company and caps per subsector, sector and theme.

    Relaxed step by step while positions stay open: without the subsector cap, without the score
    floor, without any rule. ``df``: keys, sid, company, sector, subsector, theme, score.
    Returns the picks with ``position`` (1-based) and the ``step`` (0..3) that filled the list.
    """
    caps = {"sector": max_sector, "subsector": max_subsector, "theme": max_theme}
    row = F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("_o"), "sid", "company", "sector", "subsector", "theme", "score")
    g = _candidates(df, keys, n).groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    rows = F.col("rows")
    g = (g.withColumn("s0", _greedy(rows, n, caps, min_score, True)).withColumn("s1", _greedy(rows, n, caps, min_score, False))
         .withColumn("s2", _greedy(rows, n, caps, None, False)))
    rest = F.filter(rows, lambda r: ~F.array_contains(F.transform("s2", lambda s: s["sid"]), r["sid"]))
    full = F.concat("s2", F.slice(rest, 1, n))
    step = F.when(F.size("s0") == n, 0).when(F.size("s1") == n, 1).when(F.size("s2") == n, 2).otherwise(3)
    g = g.withColumn("step", step).withColumn(
        "sel", F.when(F.col("step") == 0, F.col("s0")).when(F.col("step") == 1, F.col("s1")).when(F.col("step") == 2, F.col("s2"))
        .otherwise(F.slice(full, 1, n)))
    return (g.select(*keys, "step", F.posexplode("sel").alias("pos", "r"))
            .select(*keys, "step", (F.col("pos") + 1).alias("position"), "r.sid", "r.company", "r.sector", "r.subsector", "r.theme", "r.score"))


def diagnostics(picks: DataFrame, keys: list[str], min_score: float = 50.0) -> DataFrame:
    """Composition of the picks: dominant theme and sector, lowest score, names below the floor.

    ``picks`` may carry ``fx_corr``; its sign labels exporters and domestic names.
    """
    theme = picks.groupBy(*keys, "theme").agg(F.count("*").alias("c")).groupBy(*keys).agg(
        F.max(F.struct("c", "theme")).alias("_th"))
    sector = picks.groupBy(*keys, "sector").agg(F.count("*").alias("c")).groupBy(*keys).agg(F.max("c").alias("top_sector_count"))
    fx = F.col("fx_corr") if "fx_corr" in picks.columns else F.lit(None).cast("double")
    base = picks.groupBy(*keys).agg(F.min("score").alias("min_score"), F.count_if(F.col("score") < min_score).alias("below_threshold"),
                                    F.count_if(fx > 0.2).alias("exporters"), F.count_if(fx < -0.2).alias("domestic"))
    return (base.join(theme, keys).join(sector, keys)
            .select(*keys, F.col("_th.theme").alias("dominant_theme"), F.col("_th.c").alias("dominant_count"), "top_sector_count",
                    "min_score", "below_threshold", "exporters", "domestic"))


def quality_flags(diag: DataFrame, coverage: Column, keys: list[str]) -> DataFrame:
    """Warnings on data coverage, concentration and weak picks, as a list of flag names."""
    f = F.array_compact(F.array(
        F.when(coverage < 0.60, "low_coverage"),
        F.when((F.col("dominant_count") >= 3) & (F.col("dominant_theme") != "other"), "theme_concentration"),
        F.when(F.col("top_sector_count") >= 3, "sector_concentration"), F.when(F.col("below_threshold") > 0, "below_threshold")))
    return diag.select(*keys, F.explode(f).alias("flag"))
