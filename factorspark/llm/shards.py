"""Uniform shuffle into shards of exact size by a communication matrix; DataFrame functions only.

A uniform permutation of all rows, cut into shards, sends a random number of rows from each input partition to each shard. These
counts follow a multivariate hypergeometric law and are drawn first, as a matrix. Each partition then permutes its rows and deals
them out by its row of the matrix; each shard permutes what it gets. No step looks at all rows together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import before, settle

SHARDS, PARTITIONS, SEED = 8, 64, 4
#: Partitions whose part of the matrix is drawn in one row; rows of one sorted chunk on average, and chunks of a group at most.
BRANCH, CHUNK, MOST_CHUNKS = 8, 5_000, 100_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(2.0**53)


def _let(value: Column, then) -> Column:
    """Names a value for use in an expression, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` rows out of ``total`` are among the ``good`` ones, by inversion at the uniform number ``u``.

    The support is summed outwards from the most likely value by the ratio of neighbouring probabilities, up to 12 standard deviations and
    some more, beyond which a double's sum does not change; then walked in the same order until the running sum reaches ``u``.
    """
    def up(k: Column, s: Column) -> Column:
        return (s["good"] - k) * (s["draws"] - k) / ((k + 1) * (s["total"] - s["good"] - s["draws"] + k + 1))

    def down(k: Column, s: Column) -> Column:
        return k * (s["total"] - s["good"] - s["draws"] + k) / ((s["good"] - k + 1) * (s["draws"] - k + 1))

    def walk(s: Column, ratio, step: int, goal: Column | None) -> Column:
        """Sum of the weights on one side; with a goal, the place where the sum reaches it."""
        def one(a: Column, i: Column) -> Column:
            k = s["mode"] + (i - 1) * step
            weight = a["weight"] * F.greatest(ratio(k, s), F.lit(0.0))
            there = a["place"]
            if goal is not None:
                there = F.when((a["sum"] < goal) & (weight > 0), k + step).otherwise(there)
            return F.struct(weight.alias("weight"), (a["sum"] + weight).alias("sum"), there.alias("place"))

        start = F.struct(F.lit(1.0).alias("weight"), F.lit(0.0).alias("sum"), s["mode"].alias("place"))
        return F.aggregate(F.sequence(F.lit(1), s["reach"]), start, one)

    d = lambda c: c.cast("double")
    share = d(good) / F.greatest(d(total), F.lit(1.0))
    deviation = F.sqrt(d(draws) * share * (1 - share))
    mode = F.floor((d(draws) + 1) * (d(good) + 1) / (d(total) + 2))
    mode = F.least(F.greatest(mode, good + draws - total, F.lit(0)), good, draws)
    named = F.struct(d(total).alias("total"), d(good).alias("good"), d(draws).alias("draws"), d(mode).alias("mode"), (F.ceil(deviation * 12) + 20).cast("int").alias("reach"), u.alias("u"))

    def chosen(s: Column) -> Column:
        sides = F.struct(walk(s, up, 1, None)["sum"].alias("above"), walk(s, down, -1, None)["sum"].alias("below"))

        def pick(w: Column) -> Column:
            goal = s["u"] * (1 + w["above"] + w["below"])
            return F.when(goal < 1, s["mode"]).when(goal < 1 + w["above"], walk(s, up, 1, goal - 1)["place"]).otherwise(walk(s, down, -1, goal - 1 - w["above"])["place"])

        return _let(sides, pick)

    return _let(named, chosen).cast("long")


def deal(parts: Column, room: Column, level: int, seed: int) -> Column:
    """Rows of the matrix: for parts (id, n) in order, how many of their rows each shard with the given room gets.

    Every part draws without replacement from the room that the parts before it left; a part goes through the shards likewise.
    """
    def part(state: Column, p: Column) -> Column:
        def shard(s: Column, i: Column) -> Column:
            here = F.element_at(state["room"], i)
            u = uniform(F.lit(seed), F.lit(level), p["id"], i)
            got = hypergeometric(s["total"], here, s["left"], u)
            return _let(got, lambda x: F.struct((s["total"] - here).alias("total"), (s["left"] - x).alias("left"), F.concat(s["out"], F.array(x)).alias("out")))

        total = F.aggregate(state["room"], F.lit(0).cast("long"), lambda a, x: a + x)
        start = F.struct(total.alias("total"), p["n"].alias("left"), F.array().cast("array<bigint>").alias("out"))
        row = F.aggregate(F.sequence(F.lit(1), F.size(state["room"])), start, shard)["out"]
        return _let(row, lambda r: F.struct(F.zip_with(state["room"], r, lambda a, b: a - b).alias("room"), F.concat(state["rows"], F.array(F.struct(p["id"].alias("id"), r.alias("counts")))).alias("rows")))

    start = F.struct(room.alias("room"), F.array().cast("array<struct<id:int,counts:array<bigint>>>").alias("rows"))
    return F.aggregate(parts, start, part)["rows"]


def matrix(sizes: DataFrame, shards: int, seed: int, branch: int = BRANCH) -> DataFrame:
    """part and counts by shard, for partitions (part, n). Drawn for branches of partitions first, then inside every branch apart."""
    b = sizes.withColumn("of", F.floor(F.col("part") / branch).cast("int"))
    branches = b.groupBy("of").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.col("part").alias("id"), F.col("n")))).alias("parts"))
    whole = branches.agg(F.sort_array(F.collect_list(F.struct(F.col("of").alias("id"), F.col("n")))).alias("parts"), F.sum("n").alias("all"))
    even = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.floor(F.col("all") / shards) + F.when(i < F.col("all") % shards, 1).otherwise(0))
    whole = settle(whole.filter("all > 0").withColumn("room", even))
    top = whole.select(F.explode(deal(F.col("parts"), F.col("room"), 0, seed)).alias("row")).select(F.col("row.id").alias("of"), F.col("row.counts").alias("room"))
    return branches.join(top, "of").select(F.explode(deal(F.col("parts"), F.col("room"), 1, seed)).alias("row")).select(F.col("row.id").alias("part"), F.col("row.counts").alias("counts"))


def shuffle_shards(docs: DataFrame, shards: int = SHARDS, partitions: int = PARTITIONS, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """Deals all rows of ``docs`` (doc_id, text) to shards whose counts are at most one apart, in a uniformly random order.

    Returns doc_id, size (UTF-8 bytes of the text and one more), text_crc32, law (``rows``), shard, slot (its place in the
    shard, from 0) and a null grown_shard. A null text has size 1 and the checksum of an empty one. Every row is dealt on its own: rows that repeat
    each other and equal texts are spread like others, as a group of a third of all rows fits no shard. Other columns are
    not read; an empty table gives an empty result. Sorts see id, size and checksum only, in chunks of ``chunk`` rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = settle(docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("row")))
    base = base.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(partitions)).cast("int"))
    sizes = base.groupBy("part").agg(F.count("*").alias("n"))
    counts = settle(matrix(sizes, shards, seed))
    rows = base.count()

    def permuted(df: DataFrame, by: str, groups: int, salt: int, name: str) -> DataFrame:
        """The place of each row in a random order of its group."""
        chunks = min(MOST_CHUNKS, max(1, rows // groups // chunk))
        key = f"key_{name}"
        df = df.withColumn(key, uniform(F.lit(seed), F.lit(salt), F.col("row")))
        return before(df, [by], [F.col(key), F.col("row")], F.floor(F.col(key) * chunks), chunks, F.lit(1), name)

    placed = permuted(base, "part", partitions, 1, "place")
    dealt = placed.join(F.broadcast(counts.withColumnRenamed("part", "of")), F.col("part") == F.col("of"))  # one row for each partition
    ends = F.transform(F.col("counts"), lambda _, i: F.aggregate(F.slice(F.col("counts"), 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    dealt = dealt.withColumn("shard", F.size(F.filter(ends, lambda e: e <= F.col("place"))).cast("int"))
    return permuted(dealt, "shard", shards, 2, "slot").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
