"""The corpus pipeline: documents through five operators, each stage written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyglass.llm import classifier, jaccard, mixing, packing, secrets
from tallyglass.llm.common import find_package, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject."""
    find_package(spark)
    return classifier.keep_good(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    find_package(spark)
    return jaccard.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark."""
    find_package(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: documents repeated or cut by the blocks the mix takes.

    ``docs`` is a plain read of the stage before's files.
    """
    find_package(spark)
    return mixing.mix(docs, mixing.TEXT_BLOCK_WORDS, from_files=True)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in windows of 1024, with their token ids: a window is its pieces in order of offset."""
    find_package(spark)
    return packing.concatenate_and_cut(docs, with_ids=True)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", one_of_each),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("pack_windows", pack_windows),
]

#: The classifier, the hashes and the tokenizer have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
