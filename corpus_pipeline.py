"""From raw documents to token digests in five stages, each over all that the stage before kept.

Every stage is written as Parquet into the shared folder and read again, so that an executor lost later costs no earlier work.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from factorspark.llm import bpe, langid, mix, mph, simhash
from factorspark.llm.common import checkpoint_root


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in none of the languages learnt from the labelled rows, null texts and texts without a letter.

    A document goes if its n-grams are less likely under every language than if all were equally likely (``langid.Model.known``). Without a labelled row
    every text with a letter stays. Repeated rows have the same fate; an empty table gives an empty one; columns are passed whatever their names.
    """
    return langid.known_only(docs, langid.train(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the best row of equal texts: the longest, then the smallest doc_id, null last; one of rows that repeat each other. Needs lang and source."""
    return mph.keep_rows(docs, mph.exact_dedup(docs).filter("kept").select("doc_id", "text_key"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked fingerprints, the one with the smallest doc_id, null last, of several texts under it one.

    Null and empty texts have one fingerprint, so one of them stays. Repeated rows count once. Needs lang and source."""
    return mph.keep_rows(docs, simhash.survivors(simhash.near_dedup(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources says: not at all, once or twice.

    Null sources are one source. Documents without a word are not taken. Rows that repeat each other are documents of their own. Needs lang and source."""
    return mix.take(docs, mix.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, a row for each row; a null text counts as empty. Other columns go."""
    return bpe.encode(docs, ids=False)


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("SimHash near-dedup", near_dedup), ("mixing sources", mix_sources), ("byte-level BPE", encode)]

#: Shuffled fingerprints, a fitted model and BPE are beyond SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder. An empty table gives an empty result; columns besides those of documents are passed up to the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
