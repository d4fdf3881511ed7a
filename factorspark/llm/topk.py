"""Exact top-k search by aggregation without random access.

In a block of candidates every dimension is a list sorted by component. A query reads the lists of its positive components from the top
and those of its negative ones from the bottom, all to the same depth. What it has read gives each candidate a lower
and an upper bound of its score: dimensions not yet seen count with the smallest component of the list, or with
the last one read. Reading stops when few candidates can still come before the k-th best lower bound; only these get final scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorspark.llm.common import ship

K, SCALE, EVERY = 20, 64, 20
#: Candidates of a block, queries of a slot, queries that share the work arrays.
BLOCK, SLOT, TOGETHER = 8192, 2048, 256
#: Parts of the lists read in turn, and the share of candidates that may be left when final scores are computed.
DEPTHS, LEFT = (1 / 8, 1 / 4, 3 / 8, 1 / 2, 3 / 4, 1.0), 0.02
EXACT = 2.0**53
_LONG = 2**63 - 1


class Lists:
    """Sorted lists of a block of candidates: components (rows by dimensions) as whole numbers in doubles."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        order = np.argsort(rows, axis=0, kind="stable")
        self.place = np.empty_like(order)
        np.put_along_axis(self.place, order, np.arange(len(rows))[:, None], axis=0)
        self.sorted = np.take_along_axis(rows, order, axis=0)

    def read(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the first ``depth`` entries from the top and from the bottom hold: seen or not, and the last entry of each list."""
        n = len(self.rows)
        return self.place >= n - depth, self.place < depth, self.sorted[n - depth], self.sorted[depth - 1]


def best(lists: Lists, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the candidates, as indexes, that are among its k best, and their scores; more where scores are equal."""
    n = len(lists.rows)
    scale = float(np.abs(queries).max(initial=0) * np.abs(lists.rows).max(initial=0)) * max(1, queries.shape[1])
    slack = 0.0 if scale < EXACT else scale * 1e-9
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    self_hit = own[:, None] == ids[None, :]
    for part in DEPTHS:
        depth = min(n, max(1, int(np.ceil(n * part))))
        top, bottom, last_top, last_bottom = lists.read(depth)
        known = up @ np.where(top, lists.rows, 0.0).T + down @ np.where(bottom, lists.rows, 0.0).T
        new_up, new_down = (~top).astype(float).T, (~bottom).astype(float).T
        upper = known + (up * last_top) @ new_up + (down * last_bottom) @ new_down
        lower = known + (up * lists.sorted[0]) @ new_up + (down * lists.sorted[-1]) @ new_down
        lower[self_hit] = -np.inf
        bar = np.partition(lower, n - k, axis=1)[:, n - k] if n >= k else np.full(len(queries), -np.inf)
        alive = (upper >= (bar - 2 * slack)[:, None]) & ~self_hit
        if depth == n or alive.sum() <= LEFT * alive.size:
            break
    found = []
    for i in range(len(queries)):
        at = np.flatnonzero(alive[i])
        if scale < EXACT:
            score = (lists.rows[at] @ queries[i]).astype(np.int64)
        else:  # whole numbers of any size; what a long cannot hold ends at its limits
            q = [int(x) for x in queries[i]]
            score = np.array([max(-_LONG, min(_LONG, sum(int(a) * b for a, b in zip(lists.rows[j], q, strict=True)))) for j in at], np.int64)
        order = np.lexsort((ids[at], -score))[:k]
        found.append((at[order], score[order]))
    return found


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK, slot: int = SLOT) -> DataFrame:
    """The k best candidates of each query: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding; a component counts as floor(64 x). Queries are the rows whose vec_id is divisible by
    ``every``, candidates all rows with another vec_id. Null ids, null vectors and those with a null, NaN or infinite component take no
    part. A shorter vector counts as filled up with zeros. Rows that repeat an id with the same vector are one query, but a candidate each;
    with another vector they are queries of their own under the same id. Ties go to the smaller vec_id. Fewer candidates than k
    give fewer rows, an empty table none; other columns are not read.

    Candidates are packed into blocks where they are read; a task compares about one block with one slot. Queries are dealt to slots of about ``slot`` rows, and each block is compared with
    each slot: a stated set of queries against all rows. Blocks return k rows for each query, and the last step ranks those.
    """
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = ship(vectors).filter("vec_id is not null and embedding is not null").filter(~F.coalesce(odd, F.lit(True)))
    exact = F.transform("embedding", lambda x: x.cast("double") * SCALE)
    fit = fit.select(F.col("vec_id").cast("long"), exact.alias("v"))
    # what a query counts as: whole numbers without zeros at the end, so that equal vectors are one query
    whole = F.transform("v", lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))
    last = F.coalesce(F.array_max(F.transform("v", lambda x, i: F.when(x != 0, i + 1).otherwise(0))), F.lit(0))
    asked = fit.filter(F.col("vec_id") % every == 0).select("vec_id", whole.alias("v")).select("vec_id", F.slice("v", F.lit(1), last).alias("v")).distinct()
    slots = max(1, -(-asked.count() // slot))
    pairs = min(100_000, slots * max(1, -(-fit.count() // block)))
    queries = asked.groupBy(F.pmod(F.xxhash64("vec_id", "v"), F.lit(slots)).cast("int").alias("slot")).agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(ids: list, rows: list) -> pa.RecordBatch:
            width = max(map(len, rows))
            return pa.RecordBatch.from_arrays([pa.array([np.array(ids, np.int64).tobytes()]), pa.array([np.floor(_matrix(rows, width)).tobytes()]), pa.array([width], pa.int32())], ["ids", "rows", "width"])

        ids: list = []
        rows: list = []
        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            rows += batch.column("v").to_numpy(zero_copy_only=False).tolist()
            while len(ids) >= block:
                yield packed(ids[:block], rows[:block])
                ids, rows = ids[block:], rows[block:]
        if ids:
            yield packed(ids, rows)

    blocks = fit.mapInArrow(pack, "ids binary, rows binary, width int").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width = batch.column("width")[i].as_py()
                ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                rows = np.frombuffer(batch.column("rows")[i].as_py()).reshape(len(ids), width)
                asked = batch.column("queries")[i].values
                own = asked.field("vec_id").to_numpy()
                vectors = asked.field("v").to_numpy(zero_copy_only=False)
                wide = max(width, max(map(len, vectors)))
                q = np.floor(_matrix(list(vectors), wide))
                lists = Lists(np.pad(rows, ((0, 0), (0, wide - width))))
                for a in range(0, len(own), TOGETHER):
                    found = best(lists, ids, q[a : a + TOGETHER], own[a : a + TOGETHER], min(k, len(ids)))
                    n = [len(at) for at, _ in found]
                    # the same in every block, however wide its vectors are
                    mark = [xxhash.xxh64_intdigest((np.trim_zeros(x, "b") + 0.0).tobytes()) >> 1 for x in q[a : a + TOGETHER]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own[a : a + TOGETHER], n)), pa.array(np.repeat(np.array(mark, np.int64), n)), pa.array(np.concatenate([ids[at] for at, _ in found])), pa.array(np.concatenate([s for _, s in found]))], ["query_id", "mark", "vec_id", "score"])

    found = blocks.join(queries, "slot").select("ids", "rows", "width", "queries").repartition(pairs).mapInArrow(search, "query_id long, mark long, vec_id long, score long")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
