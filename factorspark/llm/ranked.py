"""Ranked lexical search turned round: the items' terms are the index, the documents stream through it.

The items are few beside the documents. So the inverted index is built over the terms of the items: for each term the items that
hold it and how often. It is broadcast, and each document's term counts run through it once, which gives the
document's scores for all items. A task holds a heap of the best documents for each item, so what it returns does not grow with what it
reads; the tasks' heaps are then merged by rank.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorspark.llm.common import as_bytes, checkpoint_root, settle, ship

#: ASCII letters, digits and everything beyond ASCII; of bytes, which gives the same matches in UTF-8.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Documents of an item that are kept; postings and items of one index, about, which bounds what is collected and broadcast at once.
TOP, POSTINGS, ITEMS = 20, 200_000, 5_000
#: Documents whose scores for all items are held at once, times items.
CELLS = 1 << 20


def terms(text: bytes | None) -> list[bytes]:
    return TERM.findall((text or b"").lower())  # of bytes: only A-Z


def postings(items: DataFrame) -> DataFrame:
    """key (of the text), term, tf: a row for each distinct term of each distinct text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key"), as_bytes(batch.column("text")), strict=True):
                found = Counter(terms(text))
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(found), pa.binary()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["key", "term", "tf"])

    return items.select("key", "text").mapInArrow(run, "key binary, term binary, tf long")


def counted(docs: DataFrame, names: list[bytes]) -> DataFrame:
    """doc_id, n (all terms of the document) and, of the terms in ``names``, the places and counts of those it holds.

    Documents without any term go: they count nowhere.
    """
    spark = docs.sparkSession
    index = spark.sparkContext.broadcast({t: i for i, t in enumerate(names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = index.value
        for batch in batches:
            ids, sizes, at, n, ends = [], [], [], [], [0]
            for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                found = terms(text)
                if not found:
                    continue
                ids.append(doc)
                sizes.append(len(found))
                for t, k in Counter(found).items():
                    i = place.get(t)
                    if i is not None:
                        at.append(i)
                        n.append(k)
                ends.append(len(at))
            cols = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((at, pa.int32()), (n, pa.int64())))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "at", "tf"])

    return ship(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, at array<int>, tf array<long>")


class Index:
    """Postings by term: items and how often they hold it, with the term's weight."""

    def __init__(self, rows: list[tuple[int, int, int]], weight: np.ndarray, items: int, docs: int, length: int):
        rows.sort()
        term, item, often = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 3
        self.items, self.item, self.often = items, item, often
        self.count = np.bincount(term, minlength=len(weight))
        self.first = np.cumsum(self.count) - self.count
        self.weight, self.docs, self.length = weight, docs, length

    def scores(self, n: np.ndarray, ends: np.ndarray, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Scores of some documents for all items, by whole numbers."""
        m = 75 + (25 * n * self.docs) // self.length
        doc = np.repeat(np.arange(len(n)), np.diff(ends))
        gain = self.weight[at] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        count = self.count[at]
        entry = np.arange(count.sum()) + np.repeat(self.first[at] - (np.cumsum(count) - count), count)
        total = np.zeros(len(n) * self.items, np.int64)
        np.add.at(total, np.repeat(doc, count) * self.items + self.item[entry], np.repeat(gain, count) * self.often[entry])
        return total.reshape(len(n), self.items)


def heaps(rows: DataFrame, index, top: int) -> DataFrame:
    """The best documents of each task for each item: item, doc_id, score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Index = index.value
        best: list[list[tuple]] = [[] for _ in range(x.items)]
        floor = np.zeros(x.items, np.int64)
        step = max(1, CELLS // max(1, x.items))
        for batch in batches:
            n, doc = batch.column("n").to_numpy(), batch.column("doc_id").to_pylist()
            at, tf = (batch.column(c).flatten().to_numpy() for c in ("at", "tf"))
            ends = np.concatenate([[0], np.cumsum(batch.column("at").value_lengths().to_numpy())])
            for a in range(0, len(n), step):
                b = min(len(n), a + step)
                own = slice(ends[a], ends[b])
                scores = x.scores(n[a:b], ends[a : b + 1] - ends[a], at[own], tf[own])
                for d, i in zip(*(y.tolist() for y in np.nonzero((scores > 0) & (scores >= floor))), strict=True):
                    # of equal scores the smaller id is better, and one that is null the worst
                    own_id = doc[a + d]
                    entry = (int(scores[d, i]), own_id is not None, -(own_id or 0))
                    heap = best[i]
                    if len(heap) < top:
                        heappush(heap, entry)
                    elif entry > heap[0]:
                        heapreplace(heap, entry)
                    if len(heap) == top:
                        floor[i] = heap[0][0]
        out = [(i, -doc if known else None, score) for i, heap in enumerate(best) for score, known, doc in heap]
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else ((),) * 3, kinds, strict=True)], ["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, most: int = POSTINGS) -> DataFrame:
    """The ``top`` documents of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text): item_id, rank, doc_id, score.

    Documents with score 0 are left out; ties go by ascending doc_id, null last. Null and empty texts, and texts without a term, match
    nothing and do not count as documents. Repeated documents are documents of their own; items of equal text have the same result, and items without a
    term none. Other columns are not read. Empty documents or items give an empty result. Items are searched in blocks of about ``most``
    postings, each with an index of its own, so a broadcast does not grow with the items, except that an item is never split.
    """
    spark = docs.sparkSession
    keyed = ship(items).filter("text is not null").select("item_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"), "text")
    held = settle(postings(keyed.select("key", "text").dropDuplicates(["key"])))
    size = held.agg(F.count("*").alias("n"), F.countDistinct("key").alias("items")).first()
    blocks = max(1, -(-size["n"] // most), -(-size["items"] // ITEMS))
    held = held.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        rows = held.filter(F.col("block") == block).select("key", "term", "tf").collect()
        names, texts = sorted({bytes(r["term"]) for r in rows}), sorted({bytes(r["key"]) for r in rows})
        place, item = {t: i for i, t in enumerate(names)}, {k: i for i, k in enumerate(texts)}
        path = f"{checkpoint_root(spark)}/terms-{uuid.uuid4().hex}"
        stored = counted(docs, names)
        stored.write.parquet(path)
        stored = spark.read.schema(stored.schema).parquet(path)
        total = stored.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        weight = np.zeros(len(names), np.int64)
        for r in stored.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("df")).collect():  # a row for each term of the block
            weight[r["at"]] = math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * r["df"] + 1)))
        index = Index([(place[bytes(r["term"])], item[bytes(r["key"])], r["tf"]) for r in rows], weight, len(texts), total["docs"], max(1, total["length"]))
        best = heaps(stored.select("doc_id", "n", "at", "tf"), spark.sparkContext.broadcast(index), top)
        names_of = spark.createDataFrame([(i, bytearray(k)) for k, i in item.items()], "item int, key binary")
        own = best.join(F.broadcast(names_of), "item").select("key", "doc_id", "score")
        found = own if found is None else found.unionByName(own)
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return keyed.select("item_id", "key").join(ranked, "key").select("item_id", "rank", "doc_id", "score")
