"""Applying net changes to a current-state table.

Every merge comes in two forms: the *delta* (only the keys that changed, with
``_deleted``), which is what gets written, and the whole merged table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mirrorfold.contracts import Contract

DELETED = "_deleted"


def overlay(current: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """``current`` with the delta's keys replaced, or removed where deleted."""
    kept = current.join(delta.select(key), key, "left_anti")
    return kept.unionByName(delta.filter(~F.col(DELETED)).select(*current.columns))


def full_delta(net: DataFrame, contract: Contract) -> DataFrame:
    """Net changes that carry whole rows (columns of the contract plus ``action``)."""
    return net.select(*contract.columns, (F.col("action") == "D").alias(DELETED))


def merge_full(current: DataFrame, net: DataFrame, contract: Contract) -> DataFrame:
    """Delete, update or insert each changed key; an insert of a known key and
    an update of an unknown one are both a write of that key."""
    return overlay(current, full_delta(net, contract), contract.key)


def column_delta(current: DataFrame, net: DataFrame, contract: Contract) -> DataFrame:
    """Net changes of :func:`fold_columns` resolved against the current rows.

    The join keeps every change and only looks up its row, so it is the size of
    the change set, not of the table.
    """
    now = current.select(F.col(contract.key).alias("row_id"), *[F.col(c).alias(f"_now_{c}") for c in contract.values])
    joined = net.join(now, "row_id", "left")
    columns = [F.when(F.col(f"has_{c}"), F.col(c)).when(~F.col("reset"), F.col(f"_now_{c}")).alias(c)
               for c in contract.values]
    return joined.select(F.col("row_id").alias(contract.key), *columns,
                         (F.col("action") == "D").alias(DELETED)).select(*contract.columns, DELETED)


def merge_columns(current: DataFrame, net: DataFrame, contract: Contract) -> DataFrame:
    """Existing rows overlaid with the last value of each column that came."""
    return overlay(current, column_delta(current, net, contract), contract.key)


def incomplete_rows(delta: DataFrame, contract: Contract) -> DataFrame:
    """Rows a merge would store without a required column."""
    lacking = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in contract.required]),
                       lambda c: c.isNotNull())
    return (delta.filter(~F.col(DELETED)).select(contract.key, lacking.alias("missing"))
            .filter(F.size("missing") > 0))
