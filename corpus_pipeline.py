"""A training-corpus pipeline of five stages, each run on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusguard.llm.bpe import encode_decode
from corpusguard.llm.decontaminate import drop_leaks
from corpusguard.llm.exact_dedup import drop_copies
from corpusguard.llm.near_dedup import drop_near_copies
from corpusguard.llm.quality import accepted
from corpusguard.llm.queries import table, vocabulary
from corpusguard.llm.workspace import new_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from all labelled rows outside the held-out fold."""
    return accepted(docs, table(spark, sf_dir, "labels"), training=table(spark, sf_dir, "documents"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (word 5-grams, similarity 0.8) the document with the smallest id."""
    return drop_near_copies(docs, shingle=5, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digest of the token ids, digest of the decoded text."""
    return encode_decode(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]

#: A quality model and a similarity graph aren't SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
