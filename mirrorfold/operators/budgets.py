"""Row, byte and fan-out budgets, and the prefix that fits one step."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from mirrorfold.errors import Refused
from mirrorfold.functions.payload import try_field
from mirrorfold.functions.text import utf8_bytes, utf16_bytes
from mirrorfold.operators.changes import ENVELOPE_BYTES, TXN
from mirrorfold.operators.ordered import running_sums
from mirrorfold.session import any_row
from mirrorfold.settings import Limits

# Fixed value: bytes estimated for a report row besides its description.
REPORT_ROW_BYTES = 1216


def prefix_within(df: DataFrame, order: list[str], size: str, max_rows: int, max_bytes: int) -> DataFrame:
    """The longest prefix in ``order`` within both budgets. ``order`` is unique
    and sizes are not negative, so the running sums only grow.

    Action: stages the frame (:func:`running_sums`).
    """
    run = running_sums(df, order, {"_run_rows": F.lit(1), "_run_bytes": F.coalesce(F.col(size), F.lit(0))})
    return run.filter((F.col("_run_rows") <= max_rows) & (F.col("_run_bytes") <= max_bytes)).select(*df.columns)


def first_rows(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """The candidates of a step: the first rows in order (a top-n)."""
    return df.orderBy(*order).limit(rows)


def window_usage(staged: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """One row: rows, bytes and whether a window budget is exceeded.

    Partial counts meet in one small row. A limit of the budget plus one row
    would see the overflow too, but sends that many rows through one task.
    """
    used = staged.agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                      F.coalesce(F.sum("byte_count"), F.lit(0)).cast("bigint").alias("bytes"))
    return used.withColumn("exceeded", (F.col("rows") > max_rows) | (F.col("bytes") > max_bytes))


def oversized_rows(staged: DataFrame, max_bytes: int) -> DataFrame:
    return staged.filter(F.col("byte_count") > max_bytes)


def txn_usage(log: DataFrame) -> DataFrame:
    rows = log.filter(F.col("kind") == "row") if "kind" in log.columns else log
    return rows.groupBy(*TXN).agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                                  F.sum("byte_count").cast("bigint").alias("bytes"))


def txn_budget_violations(log: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """Source transactions above a budget. They are refused whole, never split."""
    return _above(txn_usage(log), max_rows, max_bytes)


def _above(usage: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    return usage.filter((F.col("rows") > max_rows) | (F.col("bytes") > max_bytes))


def incoming_description_bytes(log: DataFrame) -> DataFrame:
    text = try_field(F.col("payload"), "description", T.StringType())
    return (log.filter(F.col("table_name") == "operations").groupBy(F.col("row_id").alias("operation_id"))
            .agg(F.max(utf8_bytes(text)).alias("incoming_bytes")))


def fanout_usage(affected: DataFrame, operations: DataFrame, log: DataFrame) -> DataFrame:
    """One row: affected report rows and a generous estimate of their bytes,
    with the larger of the current and the incoming description."""
    current = operations.select(F.col("id").alias("operation_id"),
                                utf8_bytes(F.col("description")).alias("current_bytes"))
    sized = (affected.select("operation_id").join(current, "operation_id", "left")
             .join(incoming_description_bytes(log), "operation_id", "left"))
    zero = F.lit(0).cast("bigint")
    text = F.greatest(F.coalesce("current_bytes", zero), F.coalesce("incoming_bytes", zero))
    return sized.agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                     F.coalesce(F.sum(F.lit(REPORT_ROW_BYTES) + text), zero).cast("bigint").alias("bytes"))


def check_fanout(affected: DataFrame, operations: DataFrame, log: DataFrame, limits: Limits) -> None:
    """Action. Refuses a change set whose fan-out is above the budget."""
    usage = fanout_usage(affected, operations, log).first()
    if usage["rows"] > limits.projection_rows:
        raise Refused("fanout_rows", f"{usage['rows']} report rows would change")
    if usage["bytes"] > limits.projection_bytes:
        raise Refused("fanout_bytes", f"an estimated {usage['bytes']} report bytes would change")


def check_transactions(log: DataFrame, limits: Limits) -> None:
    """Action. Refuses the log when any transaction is above its budget."""
    check_usage(txn_usage(log), limits)


def check_usage(usage: DataFrame, limits: Limits) -> None:
    """Action. The same, from the rows and bytes per transaction."""
    bad = any_row(_above(usage, limits.txn_rows, limits.txn_bytes))
    if bad is not None:
        raise Refused("transaction_budget", f"transaction {bad['commit_pos']} of {bad['source']} has "
                                            f"{bad['rows']} rows and {bad['bytes']} bytes")


def queued_sizes(queue: DataFrame, operations: DataFrame, accounts: DataFrame) -> DataFrame:
    """Queued report keys with the bytes one step counts for each."""
    ops = operations.select(F.col("id").alias("operation_id"), "account_id", "description")
    acc = accounts.select(F.col("id").alias("account_id"), "name", "status")
    zero = F.lit(0).cast("bigint")
    size = F.lit(ENVELOPE_BYTES).cast("bigint")
    for text in ("name", "status", "description"):
        size = size + F.coalesce(utf16_bytes(F.col(text)), zero)
    return (queue.select("operation_id").join(ops, "operation_id", "left").join(acc, "account_id", "left")
            .select("operation_id", size.alias("byte_count")))
