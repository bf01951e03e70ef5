"""Checkpoints: how far each source is applied, and what is known about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mirrorfold.functions.positions import millis_between
from mirrorfold.operators.changes import TXN


def batch_progress(ready: DataFrame) -> DataFrame:
    """Per source of a ready log: new position, last commit, rows, transactions.
    A heartbeat moves the position and counts no rows."""
    per_txn = ready.groupBy(*TXN).agg(
        F.max("commit_ts").alias("_ts"), F.sum(F.when(F.col("kind") == "row", 1).otherwise(0)).alias("_rows"))
    return per_txn.groupBy("source").agg(
        F.max("commit_pos").alias("position"), F.max_by("_ts", "commit_pos").alias("last_commit_at"),
        F.sum("_rows").cast("bigint").alias("rows_applied"),
        F.sum(F.when(F.col("_rows") > 0, 1).otherwise(0)).cast("bigint").alias("batches_applied"))


def advance(checkpoints: DataFrame, progress: DataFrame, snapshot: bool = False) -> DataFrame:
    """Old checkpoints plus a batch. Counters add up; a snapshot restarts them."""
    old = checkpoints.select("source", *[F.col(c).alias(f"_{c}") for c in (
        "position", "last_commit_at", "rows_applied", "batches_applied")])
    joined = old.join(progress, "source", "full")
    zero = F.lit(0).cast("bigint")
    count = lambda c: (F.coalesce(c, F.col(f"_{c}")) if snapshot
                       else F.coalesce(f"_{c}", zero) + F.coalesce(c, zero))
    return joined.select("source", F.greatest("_position", "position").alias("position"),
                         F.coalesce("last_commit_at", "_last_commit_at").alias("last_commit_at"),
                         count("rows_applied").alias("rows_applied"), count("batches_applied").alias("batches_applied"))


def window_checkpoints(sources: DataFrame, checkpoints: DataFrame, window: DataFrame) -> DataFrame:
    """Checkpoints after a drained window. ``window`` is one record with the
    version and epoch of every source (arrays of structs), so its entries are
    exploded and joined by name; nothing is paired with everything."""
    entries = window.select(F.explode("versions").alias("v"), "captured_at").select(
        F.col("v.source").alias("source"), F.col("v.version").alias("_version"), F.col("v.epoch").alias("_epoch"),
        "captured_at")
    known = sources.join(checkpoints, "source", "left")
    return (known.join(F.broadcast(entries), "source", "left")
            .select("source", F.coalesce("_version", "position").alias("position"),
                    F.coalesce("_epoch", "epoch").alias("epoch"), "captured_at"))


def source_status(checkpoints: DataFrame, descriptors: DataFrame, now: Column) -> DataFrame:
    """One row per source: where it is, how old, how far behind, or not started."""
    return descriptors.join(checkpoints, "source", "left").select(
        "source", F.col("position").isNotNull().alias("initialized"), "position", "last_commit_at",
        (F.col("max_pos") - F.col("position")).alias("lag"),
        F.when(F.col("position").isNotNull(), millis_between(F.col("last_commit_at"), now)).alias("age_ms"),
        "rows_applied", "batches_applied")
