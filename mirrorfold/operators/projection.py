"""The joined report: operations with their account and transaction totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from mirrorfold.contracts import REPORT, TOTAL
from mirrorfold.operators.ledger import ACCOUNT, OPERATION, THROUGH_TRANSACTION
from mirrorfold.operators.merge import DELETED, overlay

#: Sum and number of the transactions of every operation that has any, known or not.
TOTALS = T.StructType([T.StructField("operation_id", T.StringType()), T.StructField("transaction_total", TOTAL),
                       T.StructField("transaction_count", T.LongType())])


def transaction_totals(transactions: DataFrame) -> DataFrame:
    """Sum and count per operation; partial sums are combined before the shuffle."""
    return transactions.groupBy("operation_id").agg(
        F.sum("amount").cast(TOTAL).alias("transaction_total"),
        F.count(F.lit(1)).cast("bigint").alias("transaction_count"))


def totals_delta(before: DataFrame, delta: DataFrame) -> DataFrame:
    """What a change set adds to the totals: the rows of ``delta`` as they were
    are taken away, as they are now are added. ``before`` holds at least the
    changed rows of the old table."""
    one = F.lit(1).cast("bigint")
    old = before.join(delta.select("id"), "id", "left_semi").select("operation_id", (-F.col("amount")).alias("_a"), (-one).alias("_n"))
    new = delta.filter(~F.col(DELETED)).select("operation_id", F.col("amount").alias("_a"), one.alias("_n"))
    return old.unionByName(new).groupBy("operation_id").agg(
        F.sum("_a").cast(TOTAL).alias("transaction_total"), F.sum("_n").alias("transaction_count"))


def merge_totals(totals: DataFrame, delta: DataFrame) -> DataFrame:
    """Totals after a delta. Sums and counts add up in any order; what counts nothing goes."""
    return (totals.unionByName(delta).groupBy("operation_id")
            .agg(F.sum("transaction_total").cast(TOTAL).alias("transaction_total"),
                 F.sum("transaction_count").alias("transaction_count"))
            .filter("transaction_count <> 0"))


def project(operations: DataFrame, accounts: DataFrame, transactions: DataFrame,
            ledger: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """One row per operation. A missing account keeps the operation and says so;
    an operation without transactions totals zero."""
    return project_totals(operations, accounts, transaction_totals(transactions), ledger, now)


def project_totals(operations: DataFrame, accounts: DataFrame, by_operation: DataFrame,
                   ledger: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """:func:`project` from totals that are known already."""
    by_account = accounts.select(
        F.col("id").alias("account_id"), F.col("name").alias("account_name"), F.col("status").alias("account_status"),
        F.lit(False).alias("_known"), F.col("created_at").alias("source_account_created_at"))
    touched_account = touched_operation = F.lit(None).cast("timestamp")
    if ledger is not None:
        # Both sides are unique per operation and already needed under that key.
        operation = (ledger.filter(F.col("kind").isin(OPERATION, THROUGH_TRANSACTION))
                     .groupBy(F.col("key").alias("operation_id"))
                     .agg(F.max("last_commit_ts").alias("_operation_ts")))
        by_operation = by_operation.join(operation, "operation_id", "full")
        touched_operation = F.col("_operation_ts")
    # One account may own a third of the operations. Both sides of this join are
    # plain shuffles, the form in which adaptive execution can split a hot key.
    joined = (operations.withColumnRenamed("id", "operation_id")
              .join(by_operation, "operation_id", "left")
              .join(by_account, "account_id", "left"))
    if ledger is not None:
        account = (ledger.filter(F.col("kind") == ACCOUNT)
                   .select(F.col("key").alias("account_id"), F.col("last_commit_ts").alias("_account_ts")))
        joined = joined.join(account, "account_id", "left")
        touched_account = F.col("_account_ts")
    return joined.select(
        "operation_id", "account_id", "account_name", "account_status",
        F.col("_known").isNull().alias("account_missing"), "description", "amount",
        F.coalesce("transaction_total", F.lit(0).cast(TOTAL)).alias("transaction_total"),
        F.coalesce("transaction_count", F.lit(0).cast("bigint")).alias("transaction_count"),
        "source_account_created_at",
        F.greatest(touched_account, touched_operation).alias("last_source_commit_at"),
        (F.current_timestamp() if now is None else now).alias("materialized_at"))


def rebuild_projection(tables: dict[str, DataFrame], ledger: DataFrame | None = None,
                       now: Column | None = None) -> DataFrame:
    return project(tables["operations"], tables["accounts"], tables["transactions"], ledger, now)


def projection_delta(affected: DataFrame, tables: dict[str, DataFrame], ledger: DataFrame | None = None,
                     now: Column | None = None) -> DataFrame:
    """The affected report rows anew; an operation that no longer exists comes
    back as deleted. Only affected operations and their own totals (a table, or
    the sums of their transactions), accounts and ledger entries are joined."""
    ids = affected.select("operation_id")
    operations = tables["operations"].join(ids.withColumnRenamed("operation_id", "id"), "id", "left_semi")
    if "totals" in tables:
        totals = tables["totals"].join(ids, "operation_id", "left_semi")
    else:
        totals = transaction_totals(tables["transactions"].join(ids, "operation_id", "left_semi"))
    narrow = None
    if ledger is not None:
        touched = (ids.select(F.explode(F.array(F.lit(OPERATION), F.lit(THROUGH_TRANSACTION))).alias("kind"),
                              F.col("operation_id").alias("key"))
                   .unionByName(operations.select(F.lit(ACCOUNT).alias("kind"), F.col("account_id").alias("key"))
                                .distinct()))
        narrow = ledger.join(touched, ["kind", "key"], "left_semi")
    fresh = project_totals(operations, tables["accounts"], totals, narrow, now)
    joined = ids.join(fresh, "operation_id", "left")
    return joined.select(*REPORT.columns, F.col("account_id").isNull().alias(DELETED))


def refresh_projection(report: DataFrame, affected: DataFrame, tables: dict[str, DataFrame],
                       ledger: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """The report with exactly the affected rows recomputed."""
    return overlay(report, projection_delta(affected, tables, ledger, now), REPORT.key)
