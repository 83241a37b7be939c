"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import bpe, conversations, fingerprints, interaction, licenses, linededup, minhash, packing, quality, secretscan, sql, suffixes, toxicity, urls
from panelspark.llm.common import same, table

VOCABULARY = "word_bpe_49k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), sums=True)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: their source, then directories of 4096 and of 64 ids."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.expr("doc_id div 4096").cast("string"), F.expr("doc_id div 64").cast("string"), F.col("doc_id").cast("string"))
    found = licenses.scanned(docs.select(path.alias("path"), "text"))
    return found.withColumn("doc_id", F.regexp_extract("path", "([0-9]*)$", 1).cast("long"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(table(spark, sf_dir, "documents")).drop("rest")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def n(kind: int):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")

    counts = (n(i).alias(f"n_{r.kind}") for i, r in enumerate(secretscan.BASE))
    base = F.filter("spans", lambda s: s.kind < len(secretscan.BASE))
    found = secretscan.scanned(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *counts, F.sha2(secretscan.printed(base), 256).alias("base_sha256"), secretscan.printed(F.col("spans")).alias("spans"))


def op12_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = conversations.audit(conversations.damaged(rows)).withColumnRenamed("conv_id", "of_conv")
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().join(found, same(F.col("conv_id"), F.col("of_conv")), "left")
    zeros = (F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return every.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def queries() -> dict:
    found = [op1_toxicity, op2_near_duplicates, op3_packing, op4_bpe, op5_url_filter, op6_licenses, op7_quality, op8_fingerprints, op9_line_dedup, op10_suffix_dedup, op11_secrets, op12_interaction, op13_conversations]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
