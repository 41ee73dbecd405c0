"""The corpus pipeline: raw documents to packed sequences, one operator of webloom.llm a stage.

Language ID drops documents that are of no learned language, quality rules drop those that fail them, near-dedup keeps
one document of each group, substring dedup takes repeated passages out of the texts, and packing cuts what is left
into sequences. Stages but the last return the columns of documents. What a stage wrote is deleted once the next one
has written its own.

Defined cases. Null, empty and letterless texts go in language ID, which keeps all lettered texts if no row has a label;
short ones go in the quality rules. Rows are judged one by one there, so repeated rows and rows of one or of no doc_id share
no fate; near-dedup tells rows apart by doc_id and text, keeps one row of each group (the least doc_id, null last) and one
of rows equal in both. Substring dedup and packing take each row as a document of its own; a text that lost all its words
is packed as the end id alone. Very long texts are read whole by every stage. An empty table gives no rows. Further columns,
whatever their names, are passed on up to packing, which drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import language_id, order_minhash, packing, quality, substring_dedup
from webloom.llm._spark import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.keep_one(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.remove(docs, window=35)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.bucketed(docs, 1024)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("packing", pack_sequences),
]

#: Compression, cross-parsing and tokenization can't be said in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        own = Scratch(spark)
        docs = own.write(stage(spark, docs, sf_dir), name)
        last.drop()
        last = own
    return STAGES[-1][1](spark, docs, sf_dir)
