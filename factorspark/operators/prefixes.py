"""Order statistics of growing prefixes: the median of everything up to a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.session import cut_lineage

#: Rows of a block of times and of a block of ranks, from the first split to the last.
SIZES = (1024, 32)


def expanding_median(rows: DataFrame, keys: list[str], time: str, value: str, out: str = "med") -> DataFrame:
    """Adds the median of the key's values up to and with the row's own; of an even number the mean of the middle two.

    ``time`` is a whole number from 0 on, once for each key. Null and NaN values don't count: their rows carry the median so far, null
    before the first value. The median moves by at most half a rank for each new value, so within a block of times it is one of the
    block's own values or of those old ones whose ranks lie around it at the block's start. Counts by block of ranks and block of
    times name these; a second, smaller split leaves about 150 values for 32 rows, which is all that an array ever holds. A series is numbered by
    two sorts and its counts are (rows / 1024)² numbers; the rest of the work is spread over its blocks.
    """
    if {"_t", "_v", "_k", "_m", "_r", out} & set(rows.columns):
        raise ValueError(f"columns _t, _v, _k, _m, _r and {out} are made here")
    v = F.col(value).cast("double")
    points = rows.filter(v.isNotNull() & ~F.isnan(v)).select(*keys, F.col(time).cast("long").alias("_t"), v.alias("_v"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("_t"))
    state = points.select(*keys, "_t", "_v", F.row_number().over(Window.partitionBy(*keys).orderBy("_v", "_t")).alias("_r"),
                          F.floor((n + 1) / 2).alias("_k"), (F.floor(n / 2) + 1).alias("_m"))
    group, span = list(keys), None
    for i, size in enumerate(SIZES):
        state = _narrow(state, group, span, size, f"_b{i}")
        group, span = [*group, f"_b{i}"], size
    med = (state.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_r", "_t", "_v"))).alias("_c"),
                                     F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_t", "_k", "_m"))).alias("_q"))
           .select(*keys, F.explode(F.transform("_q", lambda q: F.struct(q["_t"].alias("_t"), _middle(F.col("_c"), q).alias("_v")))).alias("_a"))
           .select(*keys, F.col("_a._t").alias("_t"), F.col("_a._v").alias("_v")))
    run = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn("_t", F.col(time).cast("long")).join(med, [*keys, "_t"], "left")
            .withColumn(out, F.last("_v", ignorenulls=True).over(run)).select(*rows.columns, out))


def _middle(candidates: Column, q: Column) -> Column:
    """Mean of the candidates, in order, from place ``_k`` to ``_m`` among those not after the question's time."""
    width = q["_m"] - q["_k"] + 1
    known = F.filter(candidates, lambda c: c["_t"] <= q["_t"])
    return F.aggregate(F.slice(known, q["_k"].cast("int"), width.cast("int")), F.lit(0.0), lambda s, c: s + c["_v"]) / width


def _narrow(state: DataFrame, group: list[str], span: int | None, size: int, name: str) -> DataFrame:
    """One split of every group into blocks of ``size`` times, each with the values that may be a median in it.

    ``state``: group, _t, _v, _r (dense rank in the group), _k and _m (places of the middle values among the group's values up to _t; null
    for values from before the group's times). ``span`` times make up a group. Returns the same with ``name``, the block, added to the group.
    """
    at = F.col("_t") if span is None else F.col("_t") % span
    block = F.when(F.col("_k").isNull(), -1).otherwise(F.floor(at / size)).cast("int")
    s = cut_lineage(state.withColumn("_at", block).withColumn("_c", F.floor((F.col("_r") - 1) / size).cast("int")))
    asked = s.filter("_k is not null").groupBy(*group, F.col("_at").alias(name)).agg(F.min("_k").alias("_lo"), F.max("_m").alias("_hi"))
    # values of each block of ranks that are older than each block of times: entries take effect in the next block
    cells = s.groupBy(*group, "_c", (F.col("_at") + 1).alias(name)).agg(F.count("*").alias("_n"))
    top = asked.groupBy(*group).agg(F.max(name).alias("_top"))
    days = cells.groupBy(*group, "_c").agg(F.min(name).alias("_from")).join(top, group).filter("_from <= _top")
    grid = days.select(*group, "_c", F.explode(F.sequence("_from", "_top")).alias(name), F.lit(0).cast("long").alias("_n"))
    cells = cells.unionByName(grid).groupBy(*group, "_c", name).agg(F.sum("_n").alias("_n"))
    old = F.sum("_n").over(Window.partitionBy(*group, "_c").orderBy(name))
    upto = F.sum("_o").over(Window.partitionBy(*group, name).orderBy("_c"))
    cells = cells.withColumn("_o", old).withColumn("_u", upto).join(asked, [*group, name])
    # the places asked for, less the values that the block itself can put in front
    near = (F.col("_o") > 0) & (F.col("_u") >= F.col("_lo") - size) & (F.col("_u") - F.col("_o") < F.col("_hi"))
    near = cells.filter(near).select(*group, name, "_c", (F.col("_u") - F.col("_o")).alias("_under"))
    under = near.groupBy(*group, name).agg(F.min("_under").alias("_under"))
    kept = ["_t", "_v", "_r"]
    past = (s.select(*group, "_c", "_at", *kept).join(near, [*group, "_c"]).filter(F.col("_at") < F.col(name))
            .select(*group, name, *kept, *[F.lit(None).cast("long").alias(c) for c in ("_k", "_m")]))
    own = (s.filter("_k is not null").withColumn(name, F.col("_at")).join(under, [*group, name], "left")
           .select(*group, name, *kept, *[(F.col(c) - F.coalesce("_under", F.lit(0))).alias(c) for c in ("_k", "_m")]))
    return past.unionByName(own).withColumn("_r", F.row_number().over(Window.partitionBy(*group, name).orderBy("_r")))
