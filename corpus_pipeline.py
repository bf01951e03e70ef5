"""The corpus pipeline: five stages over ``documents``, each written and reread.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its
predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mirrorfold.llm import bpe, decontamination, near_copies, quality_rules, secret_scan
from mirrorfold.llm.common import table
from mirrorfold.llm.queries import tokenizer_path
from mirrorfold.session import scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word similarity 0.8 or more) stays."""
    return near_copies.keep_one_of_each_group(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are replaced by a mark; every document stays."""
    return secret_scan.mask_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, digested and decoded again."""
    return bpe.round_trip_digests(docs, tokenizer_path())


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates),
          ("decontamination", decontaminated), ("secret_scan", without_secrets), ("bpe", tokens)]

# Fitted cutoffs, fingerprints and trained models are not expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and reread. *Action.*"""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            folder = scratch(spark, f"pipeline-{name}")
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
