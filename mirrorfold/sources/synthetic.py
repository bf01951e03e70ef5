"""A deterministic source generator for trials of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mirrorfold.contracts import MONEY
from mirrorfold.functions.text import stable_id

# Block size, texts, status and amount of the generated rows.
BLOCK = 100
ACCOUNT_NAME, STATUS = "benchmark account", "Active"
DESCRIPTION, AMOUNT = "synthetic operation", "12.50"


def synthetic_sources(spark: SparkSession, accounts: int, operations: int) -> dict[str, DataFrame]:
    """``accounts`` accounts; operations in blocks of 100, one account per block in turn."""
    numbered = lambda kind, n: stable_id(F.lit(kind), n.cast("string"))
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    account = spark.range(accounts).select(
        numbered("account", F.col("id")).alias("id"), F.lit(ACCOUNT_NAME).alias("name"), F.lit(STATUS).alias("status"),
        start.alias("created_at"))
    owner = F.pmod(F.floor(F.col("id") / BLOCK), F.lit(accounts))
    operation = spark.range(operations).select(
        numbered("operation", F.col("id")).alias("id"), numbered("account", owner).alias("account_id"),
        F.lit(DESCRIPTION).alias("description"), F.lit(AMOUNT).cast(MONEY).alias("amount"))
    return {"accounts": account, "operations": operation}
