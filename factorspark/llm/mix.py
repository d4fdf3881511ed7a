"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Each source is a queue of its documents in shuffled order, offered twice over. A copy's virtual finish time is the number of words its
source has offered up to its end, divided by the source's target. All copies are sorted by that time over all sources, and
taken until the total budget is reached. At any time every source has had the same part of its target, but for a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.llm.common import before, settle, word_count

#: Weights of the sources in order, repeating; the mix's share of all words; how often a source is taken at most.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Rows of one sorted chunk on average, until there are as many chunks as allowed; then chunks grow.
CHUNK, MOST_CHUNKS = 5_000, 100_000
SEED = "mix-1"


def shuffle_key() -> Column:
    """60 bits that depend on the document alone; md5 as SQL engines have it too."""
    text = F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("mark"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def row_key() -> Column:
    """Tells rows with the same doc_id apart."""
    return F.xxhash64("text", "source")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target: a row for each source.

    Sources in the order of code points, null last, have the weights in turn. With every source at its limit or at the same multiple of
    its weight, those with the smallest limit for their weight reach it first, so one pass in this order finds the multiple.
    The windows run over sources, which are pre-aggregated.
    """
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1)).withColumn("limit", F.col("source_size") * repeats)
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("full", F.coalesce(F.sum("limit").over(ahead), F.lit(0))).withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(ahead), F.lit(0)))
    s = s.withColumn("multiple", (F.sum("source_size").over(every) * F.lit(share) - F.col("full")) / F.col("open"))
    limited = F.col("limit") <= F.col("weight") * F.col("multiple")
    level = F.max(F.when(~limited, F.col("multiple"))).over(every)
    return s.select("source", "source_size", F.when(limited, F.col("limit").cast("double")).otherwise(F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, chunk: int = CHUNK) -> DataFrame:
    """Returns a row for each row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, copies, taken, source, row_key.

    ``copies`` is how often the mix takes the document, always as a whole; ``taken`` are its words times that. The copy that would
    pass the budget and all after it are left out, so the mix ends less than a document below its budget. A null or empty text has size 0
    and is not taken. Null sources are one source, the last. Rows that repeat each other are documents of their own. Ties in finish
    time go by source, shuffle key and doc_id. Only id, source and size go through the sorts; other columns are not read, and an empty
    table gives an empty result.
    """
    mark = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    base = docs.select(F.col("doc_id").cast("long"), F.col("source"), word_count().alias("size"), row_key().alias("row_key"), mark.alias("mark"), F.monotonically_increasing_id().alias("row"))
    base = settle(base.withColumn("at", shuffle_key()))
    chunks = min(MOST_CHUNKS, max(1, base.count() // chunk))
    goal = settle(targets(base, weights, share, repeats))
    spread = F.floor(F.col("at") * (chunks / 2.0**60))
    queue = before(base.filter("size > 0"), ["source"], [F.col("at"), F.col("doc_id"), F.col("mark")], F.least(spread, F.lit(chunks - 1)), chunks, F.col("size"), "offered")
    goal_of = goal.withColumnRenamed("source", "of")
    queue = queue.join(F.broadcast(goal_of) if goal.count() <= 10_000 else goal_of, F.col("source").eqNullSafe(F.col("of")))
    copies = queue.withColumn("turn", F.explode(F.array(*[F.lit(i) for i in range(repeats)])))
    copies = copies.withColumn("finish", (F.col("offered") + F.col("size") + F.col("turn") * F.col("source_size")) / F.col("target"))
    # finish times are spread by a map that keeps their order and fits them into 0 to 1
    spread = F.least(F.floor(F.col("finish") / (F.col("finish") + 1) * chunks), F.lit(chunks - 1))
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("at"), F.col("doc_id"), F.col("mark"), F.col("turn")]
    merged = before(copies.select("row", "size", "finish", "source", "at", "doc_id", "mark", "turn"), [], order, spread, chunks, F.col("size"), "served")
    budget = goal.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("all")).first()["all"] * share
    taken = merged.filter(F.col("served") + F.col("size") <= budget).groupBy("row").agg(F.count("*").alias("copies"))
    rows = base.join(goal_of, F.col("source").eqNullSafe(F.col("of"))).join(taken.withColumnRenamed("row", "taken_row"), F.col("row") == F.col("taken_row"), "left")
    copies_of = F.coalesce("copies", F.lit(0))
    return rows.select("doc_id", "size", "source_size", "target", copies_of.alias("copies"), (F.col("size") * copies_of).alias("taken"), "source", "row_key")


def take(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as ``plan``, the result of ``mix``, takes them; all columns as they are."""
    last = F.lit(2**63 - 1)  # stands for a null id
    d = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), last)).withColumn("__key", row_key())
    p = plan.select(F.coalesce("doc_id", last).alias("__doc"), F.col("row_key").alias("__key"), F.col("copies").alias("__copies"))
    same = Window.partitionBy("__doc", "__key")
    d = d.withColumn("__nth", F.row_number().over(same.orderBy("lang")))
    p = p.withColumn("__nth", F.row_number().over(same.orderBy(F.desc("__copies")))).filter("__copies > 0")
    return d.join(p, ["__doc", "__key", "__nth"]).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)
