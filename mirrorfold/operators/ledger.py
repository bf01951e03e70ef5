"""The touch ledger: the latest commit that touched each key.

A report row shows the newest commit among its operation, its account and the
transactions that are or were its own. Kept per key and also for deleted keys,
so the answer does not depend on how the log was cut into batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from mirrorfold.functions.payload import try_field
from mirrorfold.operators.ordered import values_before

OPERATION, ACCOUNT, THROUGH_TRANSACTION = "operation", "account", "through_transaction"
KEY = ["kind", "key"]


def direct_touches(log: DataFrame) -> DataFrame:
    kind = F.when(F.col("table_name") == "accounts", ACCOUNT).when(F.col("table_name") == "operations", OPERATION)
    return (log.withColumn("kind", kind).filter(F.col("kind").isNotNull())
            .select("kind", F.col("row_id").alias("key"), "commit_ts"))


def transaction_touches(transactions: DataFrame, log: DataFrame) -> DataFrame:
    """Each transaction change touches the parent it had and the one it gets.

    The parent before a change is the one the latest earlier change named, or
    the mirrored one; a delete ends it.
    """
    order = ["commit_pos", "seq", *(["sub"] if "sub" in log.columns else [])]
    named = F.when(F.col("action") == "D", F.lit("")).otherwise(
        try_field(F.col("payload"), "operation_id", T.StringType()))
    mine = (log.filter(F.col("table_name") == "transactions")
            .select(*order, "row_id", "commit_ts", named.alias("_named")))
    seen = values_before(mine, ["row_id"], order, {"_earlier": "_named"})
    mirrored = transactions.select(F.col("id").alias("row_id"), F.col("operation_id").alias("_mirrored"))
    both = seen.join(mirrored, "row_id", "left")
    before = F.coalesce("_earlier", "_mirrored")
    parents = F.array(before, F.coalesce("_named", before))
    return (both.select(F.explode(parents).alias("key"), "commit_ts")
            .filter(F.col("key").isNotNull() & (F.col("key") != ""))
            .select(F.lit(THROUGH_TRANSACTION).alias("kind"), "key", "commit_ts"))


def new_touches(pre: dict[str, DataFrame], log: DataFrame, transactions: bool = True) -> DataFrame:
    """Touches of a log; ``transactions`` says whether it may change any."""
    touched = direct_touches(log)
    if transactions:
        touched = touched.unionByName(transaction_touches(pre["transactions"], log))
    return touched.groupBy(*KEY).agg(F.max("commit_ts").alias("last_commit_ts"))


def merge_ledger(ledger: DataFrame, touched: DataFrame) -> DataFrame:
    return ledger.unionByName(touched).groupBy(*KEY).agg(F.max("last_commit_ts").alias("last_commit_ts"))
