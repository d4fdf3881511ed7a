"""Exact deduplication with a minimal perfect hash over the distinct digests of a history.

The distinct digests of the historical rows are cut into buckets. Each bucket becomes one index row: a minimal perfect hash that
gives every digest a slot of its own, and slots that hold the full digest, the locator of its winner and its count. Digests of the
other rows are looked up there. As a hash of this kind sends strangers to some slot too, the slot's bytes decide. Members
join their slot's group; the rest form groups of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.llm.common import mixed, settle, ship, text_key, WHITE

#: Digests of one bucket on average, bits of a level for each digest that it tries to place.
BUCKET, GAMMA = 32_000, 2
_LEVEL = 0x9E3779B97F4A7C15
#: Best first: most code points, then rows with an id, then the smallest id, then the first of rows that are alike.
_BEST = ["w_n", "w_null", "w_doc", "w_row"]


def digest(text: str = "text") -> Column:
    """SHA-256 of the text without ASCII white space."""
    return F.unhex(F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), WHITE, "").cast("binary"), 256))


def _places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Each level takes another eighth of the digest and another seed, so different digests part sooner or later."""
    return mixed(words[:, level % 4] ^ np.uint64(_LEVEL * (level + 1) % 2**64)) % np.uint64(size)


def build(words: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bits and the slot of each digest; ``words`` are distinct digests as rows of four 64-bit words."""
    levels: list[np.ndarray] = []
    slots, left, used = np.empty(len(words), np.int64), np.arange(len(words)), 0
    while len(left):
        size = max(8, GAMMA * len(left))
        at = _places(words[left], len(levels), size)
        bits = np.bincount(at.astype(np.int64), minlength=size) == 1
        placed = bits[at]
        slots[left[placed]] = used + np.cumsum(bits)[at[placed]] - 1
        used += int(bits.sum())
        levels.append(bits)
        left = left[~placed]
    return levels, slots


def find(levels: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """The slot of each digest: its own for members, any or -1 for others."""
    slots, left, used = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for k, bits in enumerate(levels):
        at = _places(words[left], k, len(bits))
        here = bits[at]
        slots[left[here]] = used + np.cumsum(bits)[at[here]] - 1
        used += int(bits.sum())
        left = left[~here]
    return slots


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)


_GROUP = "dig binary, w_n long, w_null int, w_doc long, w_row long, n long"


def _groups(rows: DataFrame) -> DataFrame:
    """One row for each digest, pre-aggregated before the exchange, so a digest of many rows is no burden."""
    best = F.min(F.struct(F.col("w_n"), F.col("w_null"), F.col("w_doc"), F.col("row").alias("w_row")))
    return rows.groupBy("bucket", "dig").agg(best.alias("b"), F.count("*").alias("n")).select("bucket", "dig", "b.*", "n")


def index(groups: DataFrame) -> DataFrame:
    """One row for each bucket: bits of the levels, and slots in order."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        levels, slots = build(_words(pdf["dig"]))
        pdf = pdf.iloc[np.argsort(slots)]
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1].to_numpy(), "sizes": [[len(x) for x in levels]], "bits": [np.packbits(np.concatenate(levels)).tobytes()],
                             "digs": [b"".join(pdf["dig"])], **{c: [pdf[c].to_numpy(np.int64)] for c in [*_BEST, "n"]}})

    longs = ", ".join(f"{c} array<long>" for c in [*_BEST, "n"])
    return groups.groupBy("bucket").applyInPandas(run, f"bucket long, sizes array<int>, bits binary, digs binary, {longs}")


def _look_up(new: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
    """All groups of a bucket: slots with what has joined them, and new digests without a slot."""
    if not len(entry):
        return new.assign(member=False)[["dig", *_BEST, "n", "member"]]
    e = entry.iloc[0]
    bits = np.unpackbits(np.frombuffer(e["bits"], np.uint8), count=int(np.sum(e["sizes"]))).astype(bool)
    levels = np.split(bits, np.cumsum(e["sizes"])[:-1])
    held = np.frombuffer(e["digs"], np.uint64).reshape(-1, 4)
    own = pd.DataFrame({"dig": [x.tobytes() for x in held], **{c: np.array(e[c], np.int64) for c in [*_BEST, "n"]}}).assign(member=True)
    if not len(new):
        return own
    words = _words(new["dig"])
    slots = find(levels, words)
    member = (slots >= 0) & (held[slots] == words).all(axis=1)
    hits = new[member].assign(slot=slots[member]).set_index("slot")[[*_BEST, "n"]]
    mine = own.loc[hits.index]
    better = np.zeros(len(hits), bool)
    for c in reversed(_BEST):
        a, b = hits[c].to_numpy(), mine[c].to_numpy()
        better = (a < b) | (a == b) & better
    won = hits.index[better]
    own.loc[won, _BEST] = hits.loc[won, _BEST]
    own.loc[hits.index, "n"] += hits["n"]
    return pd.concat([own, new[~member].assign(member=False)])[["dig", *_BEST, "n", "member"]]


def groups(history: DataFrame, new: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Groups of both inputs (columns row, doc_id, dig, n_points): dig, the winner's row and id, group_size, member."""
    rows = history.count()
    buckets = max(1, -(-rows // bucket))

    def prepared(df: DataFrame) -> DataFrame:
        doc = F.col("doc_id")
        return df.select("row", "dig", F.pmod(F.xxhash64("dig"), F.lit(buckets)).alias("bucket"), (-F.col("n_points")).alias("w_n"),
                         F.when(doc.isNull(), 1).otherwise(0).alias("w_null"), F.coalesce(doc, F.lit(0)).cast("long").alias("w_doc"))

    found = _groups(prepared(new)).groupBy("bucket").cogroup(index(_groups(prepared(history))).groupBy("bucket")).applyInPandas(_look_up, f"{_GROUP}, member boolean")
    return found.select("dig", F.col("w_row").alias("keep_row"), F.when(F.col("w_null") == 0, F.col("w_doc")).alias("keep_id"), F.col("n").alias("group_size"), "member")


def in_history(doc: str = "doc_id") -> Column:
    """The half of the documents that stands for what earlier runs have taken in."""
    return F.coalesce(F.crc32(F.col(doc).cast("string")) % 2 == 0, F.lit(False))


def exact_dedup(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Finds the rows of ``docs`` (doc_id, text) whose texts are equal but for ASCII white space.

    Returns a row for each row: doc_id, keep_id, group_size, kept, text_sha256, member (whether the historical half holds the text)
    and text_key. A null text counts as empty. Of equal texts the row with the most code points stays, then the smallest doc_id, then,
    of rows that repeat each other, one; a null doc_id comes last and gives a null keep_id. Other columns are not read.
    An empty table gives an empty result. The rows of a group are joined to their winner by digest, which Spark may split.
    """
    base = settle(ship(docs).select(F.col("doc_id").cast("long"), digest().alias("dig"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_points"),
                              text_key().alias("text_key"), F.monotonically_increasing_id().alias("row")))
    won = groups(base.filter(in_history()), base.filter(~in_history()), bucket)
    return base.join(won, "dig").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
                                        F.lower(F.hex("dig")).alias("text_sha256"), "member", "text_key")


def keep_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` named by ``keys`` (doc_id, text_key), one of each; all columns as they are."""
    last = F.lit(2**63 - 1)  # stands for a null id
    d = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), last)).withColumn("__key", text_key())
    k = keys.select(F.coalesce("doc_id", last).alias("__doc"), F.col("text_key").alias("__key"))
    one = Window.partitionBy("__doc", "__key").orderBy("source", "lang")
    return d.join(k, ["__doc", "__key"], "left_semi").withColumn("__nth", F.row_number().over(one)).filter("__nth = 1").select(*docs.columns)
