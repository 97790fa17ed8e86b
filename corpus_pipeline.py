"""Corpus pipeline: documents through the stages, each written and read again before the next one.

All stages but the last filter rows and keep the columns of documents; the last one gives the tokens' digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tomoloom.functions.storage import materialize
from tomoloom.llm import byte_bpe, decontaminate, exact_dedup, jaccard_join, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labelled ones among them, does not reject."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def distinct_shingles(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a shingle similarity of 0.75 or more, the one with the smallest doc_id."""
    return jaccard_join.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return byte_bpe.round_trip(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", distinct_texts),
    ("n-gram Jaccard join", distinct_shingles),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", tokens),
]

#: SQL cannot express trained classifiers, alignment or byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every earlier stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
