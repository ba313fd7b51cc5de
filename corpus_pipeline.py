"""A training corpus in five stages: quality rules, exact deduplication, near-duplicates, source weights, packing.

A null text is empty and null ids are allowed in every stage. An empty table gives an empty one. Columns beyond those of
documents are kept by all stages but the last, whatever their names. Rows repeated in full are rows of their own until
exact deduplication leaves one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, jaccard_join, mixing, packing, quality, shared


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the likelihood ratio go, so null and empty texts, which have no words. Repeated rows are judged alike; without trusted labels only the base rules reject."""
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays, null ids last; of several such rows one. Null and empty texts are equal."""
    return exact_dedup.distinct_rows(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the row with the least doc_id stays, null ids last, ties by text hash and then the other columns. Texts without words are classes of their own."""
    return jaccard_join.one_of_each(docs)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document. A null source is one of the sources; documents without words are never taken. Of equal lengths, a seeded hash of the id decides."""
    return mixing.mixed_rows(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, in sequences. A null or empty text is its end id alone; rows with equal ids, as those taken several times, are documents of their own."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("mixing sources to target weights", source_weights), ("packing", sequences)]

#: The likelihood ratio, the knapsack and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
