"""The corpus pipeline: quality classifier, near-duplicate removal, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``; the last returns the packed pieces.

Defined results, for every stage: null and empty texts are judged as texts without words (they link with each other, hold no
secret, and pack as one id); null ids, hosts and paths are values like any other; repeated rows are judged alike, and near-duplicate
removal keeps one of them; texts of any length are read whole; an empty table gives an empty table; columns beside those of
``documents``, whatever their names, pass all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spoorlake.llm import packing, quality, secret_scan, simhash
from spoorlake.llm.common import table, written

#: Chunks that a packing task remembers: less than alone, as executors carry the memory of the stages before.
PACKING_CACHE = 200_000


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces what the forest calls secrets; keeps every document."""
    return secret_scan.redact(docs, secret_scan.grow())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), cache=PACKING_CACHE)


STAGES = [
    ("quality_classifier", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: The tokenizer and the trained models have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
