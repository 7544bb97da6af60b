"""A corpus pipeline: each stage takes the documents that the stage before kept.

Quality classifier, SimHash near-dedup, substring dedup, benchmark decontamination, byte-level BPE.  All stages but the last
return the columns of documents; the last returns the token ids of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logmill.llm import bpe, decontam, quality, recompress, simhash
from logmill.llm.base import DOCUMENT_COLUMNS, staged, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from ``labels`` and these documents."""
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_copies(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that a document with a lesser doc_id has too."""
    return recompress.drop_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of ``benchmark``."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, decoded again as a check: (doc_id, lang, source, token_ids, n_tokens, round_trip)."""
    return bpe.encode_documents(docs, bpe.VOCABULARY, "lang", "source")


STAGES = [
    ("quality_classifier", classify),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("benchmark_decontamination", decontaminate),
    ("byte_level_bpe", encode),
]
#: A trained network can't be written in SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what a stage keeps is written to the shared folder and read again by the next."""
    docs, before = table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = before = staged(docs, name, after=before)
    return docs
