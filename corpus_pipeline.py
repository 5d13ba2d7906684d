"""The corpus pipeline: five stages, each an operator of calspar.llm, from documents to packed pieces.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last give the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from calspar.llm import common, decontaminate, jaccard, lines, packing, quality, queries


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a quality score of 0.7 or more, by rules learned from the labels. A null text is scored as an empty one; null ids and repeated rows are rows like any other."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), 0.7)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that repeat an earlier one but for a word; those that lose every line go. Null texts stay; rows with equal id and text are one document."""
    return lines.dedup_lines(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of similar documents. Null ids, and texts without a word, stay."""
    return jaccard.keep_one(docs, 5, 75)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a 10-word window of a benchmark item. Null texts have no words and stay."""
    return decontaminate.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids. A null text counts as empty; each row is packed, repeated or not. Workers store fewer words than by default, as the stages before have filled the executors' memory."""
    return packing.packed_digest(packing.pack(docs, queries.word_bpe(), end_id=2, length=4096, stored=200_000))


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]

#: Scores by learned rules, components and tokens have no SQL form: tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents. A stage's output is deleted once the next one is written; the last stays for the reader."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            common.deleted(spark, f"{folder}/{k - 1}")
    return docs
