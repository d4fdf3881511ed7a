"""SimHash near-duplicates found at the anchors of a covering code.

Anchors are pairs of codewords of the perfect binary Golay code [23, 12, 7] over the bits 0-22 and 23-45 of a fingerprint. The
covering radius of a block is 3: a block lies within 3 bits of exactly one codeword, its home. A fingerprint is
replicated to every anchor that can be the home of one with at most two other bits: homes in both blocks; one block
within 3 + 2 bits of its codeword and the other at home; both blocks within 3 + 1 bits. These are about 62 of 2^24 anchors.
Each anchor then compares the fingerprints at home there with all that were replicated to it, over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import as_bytes, components, settle, ship

THRESHOLD = 2
#: Generator polynomial of the binary Golay code, its length and redundancy.
GENERATOR, LENGTH, REDUNDANCY, RADIUS = 0b110001110101, 23, 11, 3
SEED, SHINGLE = 42, 3


def fingerprint(text: bytes | None) -> int:
    """64 bits; a bit is set if it is set in over half of the shingle hashes. No words: zero."""
    words = (text or b"").lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(whole, SEED)
    starts = [0, *(ends[: -SHINGLE] + 1).tolist()]
    hashed = np.fromiter((xxhash.xxh64_intdigest(whole[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)), "<u8", len(starts))
    ones = np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and the fingerprint as a signed long, a row for each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t) for t in as_bytes(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(marks)], ["doc_id", "text_key", "mark"])

    return ship(docs).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, mark long")


class Block:
    """Codewords near a block of 23 bits, by its syndrome."""

    def __init__(self) -> None:
        unit = []
        x = 1
        for _ in range(LENGTH):
            unit.append(x)
            x <<= 1
            if x >> REDUNDANCY:
                x ^= GENERATOR
        bits = np.arange(1 << 12)
        self.low = np.bitwise_xor.reduce([np.where(bits >> i & 1, unit[i], 0) for i in range(12)], axis=0)
        self.high = np.bitwise_xor.reduce([np.where(bits >> i & 1, unit[12 + i], 0) for i in range(11)], axis=0)
        errors = [sum(1 << i for i in c) for w in range(RADIUS + THRESHOLD + 1) for c in combinations(range(LENGTH), w)]
        error = np.array(errors)
        weight = np.bitwise_count(error)
        mark = self.syndrome(error)
        home = weight <= RADIUS
        self.home = np.zeros(1 << REDUNDANCY, np.int64)
        self.home[mark[home]] = error[home]
        self.near = {more: self._lists(error[~home & (weight <= RADIUS + more)], mark[~home & (weight <= RADIUS + more)]) for more in (1, 2)}

    @staticmethod
    def _lists(error: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(mark, kind="stable")
        count = np.bincount(mark, minlength=1 << REDUNDANCY)
        return error[order], np.cumsum(count) - count, count

    def syndrome(self, block: np.ndarray) -> np.ndarray:
        return self.low[block & 0xFFF] ^ self.high[block >> 12]

    def others(self, block: np.ndarray, more: int) -> tuple[np.ndarray, np.ndarray]:
        """For codewords within 3 + ``more`` bits but for the home: the index into ``block``, and the codeword's 12 free bits."""
        error, first, count = self.near[more]
        mark = self.syndrome(block)
        n = count[mark]
        at = np.repeat(np.arange(len(block)), n)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        return at, (block[at] ^ error[first[mark[at]] + nth]) >> REDUNDANCY

    def homes(self, block: np.ndarray) -> np.ndarray:
        return (block ^ self.home[self.syndrome(block)]) >> REDUNDANCY


@lru_cache(maxsize=1)
def block() -> Block:
    return Block()


def _halves(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return marks & ((1 << LENGTH) - 1), marks >> LENGTH & ((1 << LENGTH) - 1)


def home_anchor(marks: np.ndarray) -> np.ndarray:
    a, b = _halves(marks)
    return block().homes(a) << 12 | block().homes(b)


def guest_anchors(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index into ``marks`` and anchor, for all anchors that a fingerprint is replicated to."""
    a, b = _halves(marks)
    c = block()
    home_a, home_b = c.homes(a), c.homes(b)
    at, anchor = [np.arange(len(marks))], [home_a << 12 | home_b]
    i, near = c.others(a, 2)
    at.append(i), anchor.append(near << 12 | home_b[i])
    i, near = c.others(b, 2)
    at.append(i), anchor.append(home_a[i] << 12 | near)
    i, near = c.others(a, 1)
    j, near_b = c.others(b[i], 1)
    at.append(i[j]), anchor.append(near[j] << 12 | near_b)
    return np.concatenate(at), np.concatenate(anchor)


def _at_anchors(marks: DataFrame, guests: bool) -> DataFrame:
    name = "guest" if guests else "home"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column("mark").to_numpy()
            at, anchor = guest_anchors(m) if guests else (slice(None), home_anchor(m))
            yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(m[at])], ["anchor", name])

    return marks.select("mark").mapInArrow(run, f"anchor int, {name} long")


def links(marks: DataFrame) -> DataFrame:
    """Pairs of different fingerprints (column mark, distinct) with at most two other bits, each once: u, v."""
    pairs = _at_anchors(marks, True).join(_at_anchors(marks, False), "anchor")
    near = (F.col("guest") > F.col("home")) & (F.bit_count(F.col("guest").bitwiseXOR(F.col("home"))) <= THRESHOLD)
    return pairs.filter(near).select(F.col("guest").alias("u"), F.col("home").alias("v"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """Groups the rows of ``docs`` (doc_id, text) whose fingerprints are linked over any number of steps.

    Returns a row for each row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that can be reached; null if
    there is none), text_key, n_links (other fingerprints linked to the row's) and component_size. Null and empty texts
    have the fingerprint zero and are linked like others. Only distinct fingerprints are replicated, so copies cost nothing at the
    anchors. Other columns are not read; an empty table gives an empty result.
    """
    base = settle(fingerprints(docs))
    marks = settle(base.groupBy("mark").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    edges = settle(links(marks))
    degree = edges.select(F.col("u").alias("mark")).unionAll(edges.select(F.col("v").alias("mark"))).groupBy("mark").agg(F.count("*").alias("n_links"))
    rooted = marks.join(components(edges), F.col("mark") == F.col("node"), "left").withColumn("root", F.coalesce("root", "mark"))
    whole = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("component_size"))
    labels = rooted.select("mark", "root").join(whole, "root").join(degree, "mark", "left")
    return base.join(labels, "mark").select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id", "text_key",
                                            F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_size")


def survivors(result: DataFrame) -> DataFrame:
    """doc_id and text_key of the one document of each component that stays: the smallest doc_id, of several texts under it the smallest key."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best")
    return result.withColumn("id", F.coalesce(F.col("component_id").cast("string"), "fingerprint")).groupBy("id").agg(best).select("best.doc_id", "best.text_key")
