"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log-probabilities, n-gram buckets by languages. It is broadcast, and batches of texts are scored as sparse
rows: the buckets of a text's n-grams pick matrix rows, which are summed for each text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.llm.common import ship, steps

#: log2 of the number of buckets, the n-gram lengths, and labelled rows to learn from for each language at most.
BITS, ORDERS, PER_LANGUAGE = 15, (1, 2, 3), 800
UNKNOWN = "und"
#: Rows of sampled ids that may be broadcast; beyond, they are joined by shuffle.
MOST_BROADCAST = 100_000
_FACTORS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in a row, the offset of each text, and which have a letter.

    Texts are lower-cased, everything but letters counts as one kind of separator, and a separator stands at both ends, so
    that no n-gram reaches into the next text.
    """
    lowered = [t.lower() for t in texts]
    code = np.frombuffer("".join(f" {t} \x00\x00" for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 4 for t in lowered])
    ends = np.cumsum(sizes)
    code = np.where(letters()[code], code, np.uint32(32))
    code[ends - 1] = code[ends - 2] = 0
    return code, ends - sizes, np.add.reduceat(code > 32, ends - sizes, dtype=np.int64) > 0


def buckets(code: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams that begin at each place; -1 for those that say nothing."""
    out = np.empty((len(code), len(ORDERS)), np.int32)
    rolled = np.zeros(len(code), np.uint32)
    for k in range(max(ORDERS)):
        rolled[: max(0, len(code) - k)] += code[k:] * _FACTORS[k % len(_FACTORS)] + np.uint32(k)
        if k + 1 in ORDERS:
            h = rolled ^ (rolled >> np.uint32(15))
            h = h * np.uint32(0x2C1B3C6D)
            out[:, ORDERS.index(k + 1)] = (h ^ (h >> np.uint32(13))) & np.uint32((1 << BITS) - 1)
    # grams without a letter in front, or behind one separator, say nothing, nor do those that begin in the gap between texts
    letter = code > 32
    lead = letter | (code == 32) & np.append(letter[1:], False)
    for i, k in enumerate(ORDERS):
        out[~(letter if k == 1 else lead), i] = -1
    return out


def windows(code: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The buckets in order, of ``most`` places at a time; each window looks ahead as far as its last n-grams reach."""
    for a in range(0, len(code), most):
        yield buckets(code[a : a + most + max(ORDERS) - 1])[:most]


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    weight: np.ndarray

    def totals(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For slices of the texts: log-likelihoods without the prior (texts by languages), n-grams, and which texts have a letter.

        A text above the size of a slice is a slice of its own and is added up in windows, so what is held beside the text
        grows with neither its length nor the languages.
        """
        most = (1 << 20) // max(4, len(self.languages)) + 1
        for a, b in steps([len(t) for t in texts], most):
            code, first, letter = codes(texts[a:b])
            if b - a > 1:
                found = buckets(code)
                picked = self.weight[found].sum(axis=1)
                yield np.add.reduceat(picked, first, axis=0, dtype=np.float64), np.add.reduceat((found >= 0).sum(axis=1), first), letter
            else:
                total, n = np.zeros((1, len(self.languages))), np.zeros(1, np.int64)
                for found in windows(code, most):
                    total += np.add.reduceat(self.weight[found].sum(axis=1), [0], axis=0, dtype=np.float64)
                    n += (found >= 0).sum()
                yield total, n, letter

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language, its posterior probability, and whether the text has a letter."""
        best, sure, has = [], [], []
        for total, _, letter in self.totals(texts):
            total = total + self.prior
            total = np.exp(total - total.max(axis=1, keepdims=True))
            best.append(total.argmax(axis=1))
            sure.append(total.max(axis=1) / total.sum(axis=1))
            has.append(letter)
        return np.concatenate(best), np.concatenate(sure), np.concatenate(has)

    def known(self, texts: list[str]) -> np.ndarray:
        """Whether a text has a letter and is in a learnt language.

        It is in none if under each of them its n-grams are less likely, on average, than if all buckets were equally likely. That
        level is the only threshold, so it moves neither with the data nor with the length of the text. A model that has learnt little is close to
        that level everywhere and rejects little; one without languages rejects only texts without a letter.
        """
        level = -math.log(1 << BITS)
        kept = [letter & (total.max(axis=1) >= level * n if self.languages else True) for total, n, letter in self.totals(texts)]
        return np.concatenate(kept)


def fold(doc: str = "doc_id") -> Column:
    return F.crc32(F.col(doc).cast("string")) % 4


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from rows outside fold 2 that have a text and a lang.

    Takes ``per_language`` rows of each language at most, those with the smallest hash of the doc_id, and their whole texts; the priors
    count all such rows. What reaches the driver is bounded by languages times buckets.
    """
    known = ship(docs).filter("text is not null and lang is not null and doc_id is not null").filter(fold() != 2)
    prior = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(prior)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    # of a frequent language only a hash range with a few times the rows needed goes into the ranking
    part = F.create_map(*[F.lit(x) for lang, n in prior.items() for x in (lang, min(1.0, 4 * per_language / n))])[F.col("lang")] if prior else F.lit(1.0)
    near = (F.xxhash64("doc_id").cast("double") + 2.0**63) / 2.0**64 <= part
    picked = known.select("doc_id", "lang").filter(near).withColumn("nth", nth).filter(F.col("nth") <= per_language).select("doc_id", "lang").distinct()
    if per_language * len(languages) <= MOST_BROADCAST:  # rows of two short columns
        picked = F.broadcast(picked)
    sample = known.select("doc_id", "lang", "text").join(picked, ["doc_id", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for one in sorted(set(lang)):
                own = [t for t, x in zip(texts, lang, strict=True) if x == one]
                counts = np.zeros(1 << BITS, np.int64)
                for a, b in steps([len(t) for t in own]):
                    for found in windows(codes(own[a:b])[0], 1 << 20):
                        counts += np.bincount(found[found >= 0], minlength=1 << BITS)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])

    counts = np.zeros((1 << BITS, len(languages)))
    for r in sample.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"], languages.index(r["lang"])] = r["n"]
    smooth = counts + 0.5
    weight = np.log(smooth) - np.log(smooth.sum(axis=0))
    total = sum(prior.values())
    # the last row is for the bucket -1, which says nothing
    return Model(languages, np.log([prior[x] / total for x in languages]), np.vstack([weight, np.zeros(len(languages))]).astype(np.float32))


def predict(docs: DataFrame, model: Model, passed: list[str]) -> DataFrame:
    """Adds lang_pred and score to the columns ``passed``.

    The prediction takes the whole text and nothing else. A null text or one without a letter gives ``und`` with score 0, and so
    does a model without languages. Rows stay as they are, repeated ones too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = ship(docs).select(*passed, F.col("text").alias("__text"))
    schema = source.select(*passed, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            best, sure, has = m.score(texts) if m.languages else (np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool))
            names = [m.languages[i] if known else UNKNOWN for i, known in zip(best, has, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(np.where(has, np.minimum(sure, 1.0), 0.0))], [*passed, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def known_only(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose whole text is in a language of the model, all columns as they are, whatever their names; null texts and texts without a letter go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(m.known([t or "" for t in batch.column(at).to_pylist()])))

    return ship(docs).mapInArrow(run, docs.schema)


def language_id(docs: DataFrame, passed: list[str] | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Trains on ``docs`` and predicts for all its rows: doc_id, held_out, lang_pred, score; or ``passed`` columns with both.

    held_out is false for a null doc_id, which is never learnt from either. An empty table gives an empty result.
    """
    model = train(docs, per_language)
    if passed is not None:
        return predict(docs, model, passed)
    marked = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "text")
    return predict(marked, model, ["doc_id", "held_out"])
