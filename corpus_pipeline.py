"""Training-data pipeline over the table documents, a stage after another.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.llm import common, decontam, pieces, quality, registry, simhash, substring


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on all labels, rejects go."""
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"), F.lit(True))
    return quality.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-duplicates the document with the smallest id stays."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 50 that a document with a smaller id also has go; n_chars is that of the new text."""
    return substring.remove_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy, whole or edited, of a benchmark item go."""
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of ids and decoded text."""
    return pieces.encode_documents(docs, registry.tokenizer_path(), with_ids=True)


STAGES = [("quality", good_quality), ("near_dedup", near_dedup), ("substring", substring_dedup), ("decontamination", decontaminate), ("sentencepiece", encode)]

#: Dictionary compression, XXH64 fingerprints and alignment are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table is dropped as soon as the next one is written."""
    docs, before = common.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir), name)
        common.drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
