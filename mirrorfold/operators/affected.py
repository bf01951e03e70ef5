"""Which report rows a change set touches, and the queue that holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from mirrorfold.functions.payload import try_field
from mirrorfold.operators.merge import DELETED

#: Which operations an account has: the operations' own key turned round.
OWNED = T.StructType([T.StructField("account_id", T.StringType()), T.StructField("id", T.StringType())])


def owned_delta(before: DataFrame, delta: DataFrame) -> DataFrame:
    """Pairs of account and operation that a change of operations ends or begins,
    with ``_deleted``. ``before`` holds at least the changed rows of the old table."""
    old = before.join(delta.select("id"), "id", "left_semi").select("account_id", "id")
    new = delta.filter(~F.col(DELETED)).select("account_id", "id")
    return (old.withColumn("_n", F.lit(-1)).unionByName(new.withColumn("_n", F.lit(1))).groupBy("account_id", "id")
            .agg(F.sum("_n").alias("_n")).filter("_n <> 0").select("account_id", "id", (F.col("_n") < 0).alias(DELETED)))


def merge_owned(owned: DataFrame, delta: DataFrame) -> DataFrame:
    kept = owned.join(delta.filter(DELETED).select("account_id", "id"), ["account_id", "id"], "left_anti")
    return kept.unionByName(delta.filter(~F.col(DELETED)).select("account_id", "id"))


def _of(log: DataFrame, table: str) -> DataFrame:
    return log.filter(F.col("table_name") == table)


def operations_of_accounts(operations: DataFrame, log: DataFrame) -> DataFrame:
    """Operations of a changed account. A semi join: one output row per
    operation however often its account changed."""
    changed = _of(log, "accounts").select(F.col("row_id").alias("account_id")).distinct()
    return operations.join(changed, "account_id", "left_semi").select(F.col("id").alias("operation_id"))


def changed_operations(log: DataFrame) -> DataFrame:
    return _of(log, "operations").select(F.col("row_id").alias("operation_id")).distinct()


def old_parents(transactions: DataFrame, log: DataFrame) -> DataFrame:
    """Parents of changed transactions as mirrored before the change."""
    changed = _of(log, "transactions").select(F.col("row_id").alias("id")).distinct()
    return transactions.join(changed, "id", "left_semi").select("operation_id").distinct()


def new_parents(log: DataFrame) -> DataFrame:
    """Parents named by any transaction change of the set, also intermediate ones."""
    parent = try_field(F.col("payload"), "operation_id", T.StringType())
    return (_of(log, "transactions").filter(F.col("action") != "D").select(parent.alias("operation_id"))
            .filter(F.col("operation_id").isNotNull()).distinct())


def affected_operations(pre: dict[str, DataFrame], log: DataFrame) -> DataFrame:
    """Distinct operations whose report row may change. ``pre`` are the mirrors
    *before* the change set is merged; of them, the operations of changed
    accounts (``owned``, where it is kept) and changed transactions are read."""
    return (operations_of_accounts(pre.get("owned", pre["operations"]), log)
            .unionByName(changed_operations(log))
            .unionByName(old_parents(pre["transactions"], log))
            .unionByName(new_parents(log)).distinct())


def enqueue(queue: DataFrame, found: DataFrame) -> DataFrame:
    """Adds what is not queued yet."""
    fresh = found.select("operation_id").distinct().join(queue, "operation_id", "left_anti")
    return queue.select("operation_id").unionByName(fresh)


def consume(rows: DataFrame, taken: DataFrame, key: list[str]) -> DataFrame:
    """What is left of a stage or queue after ``taken`` was processed."""
    return rows.join(taken.select(*key), key, "left_anti")
