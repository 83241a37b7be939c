"""From documents to packed training windows: toxicity, line dedup, near-dedup, suffix dedup, packing.

Each stage reads what its predecessor kept and returns the columns of documents, the last its packed pieces.

Results for odd input: columns besides those of documents are left aside, whatever their names. A document without a word
(null, empty or blank text) passes toxicity and goes at line dedup, as there is nothing left to train on. Of rows that
share a doc_id all go where one is toxic or near-duplicates an earlier document, and none goes for being like another of
them. A null doc_id is no one's copy and comes first in order. Texts of any length are taken whole. Without labels no
document is toxic. An empty table gives an empty table of the same columns at every stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import linededup, minhash, packing, suffixes, toxicity
from panelspark.llm.common import same, shared_folder, table

REST = ["lang", "source"]


def documents(rows: DataFrame) -> DataFrame:
    """doc_id, text and the struct rest as the columns of documents."""
    return rows.select("doc_id", "text", "rest.lang", "rest.source", F.length("text").cast("long").alias("n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models reject go."""
    rejected = toxicity.scored(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(F.col("doc_id").alias("rejected")).distinct()
    return docs.join(rejected, same(F.col("doc_id"), F.col("rejected")), "left_anti")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that stand earlier already go; a document of which no word is left goes."""
    return documents(linededup.deduplicated(docs, REST)).where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    gone = minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long strings that stand earlier already go; a document of which no word is left goes."""
    left = suffixes.removed(docs, REST, as_text=True)
    return documents(left.withColumnRenamed("kept", "text")).where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens: pieces with their ids and places."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near), ("suffix_dedup", drop_repeats), ("packing", pack)]

#: No SQL: the first stage is a trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
