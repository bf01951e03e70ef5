"""One streaming query applies the logs of both sources to one store.

``foreachBatch`` may run a batch again, and files may arrive in any order. The
effect is idempotent by positions alone: a checkpoint moves only over whole
transactions without a gap before them, so what lies at or below it is a
replay, and everything else is kept until it is whole. The manifest is
published before Spark commits the batch, never after.
"""

from __future__ import annotations

import copy
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from mirrorfold.contracts import ENVELOPE
from mirrorfold.errors import Refused
from mirrorfold.operators.budgets import check_usage
from mirrorfold.operators.changes import (
    MARKS, READY, TXN, after_checkpoint, conflicting_rows, counted_bytes, counted_transactions, distinct_changes, faults_of,
    is_outside, rows_outside, split_key_changes, with_ready)
from mirrorfold.operators.checks import SourceDescriptor, domain_problem, guard_position
from mirrorfold.operators.progress import advance, batch_progress
from mirrorfold.plans.apply import changes_of, guard_log
from mirrorfold.plans.lifecycle import (
    as_time, batch_facts, checkpoints_frame, open_metrics, open_since, require_binding, utc_now, write_facts)
from mirrorfold.plans.stored import StoredTables
from mirrorfold.session import any_row, together
from mirrorfold.settings import Limits
from mirrorfold.sources.changelog import read_change_log
from mirrorfold.sources.store import Store


def guard_start(store: Store, descriptors: dict[str, SourceDescriptor], limits: Limits) -> dict:
    """Action. Identity, retention and lag checks before any message is read."""
    manifest = store.require()
    require_binding(manifest, descriptors)
    for source, descriptor in descriptors.items():
        checkpoint = manifest["published"]["checkpoints"].get(source)
        if checkpoint is None:
            raise Refused("no_snapshot", f"{source} has no snapshot; load it first")
        guard_position(descriptor, checkpoint, limits.lag_bytes)
    return manifest


def sync_batch(store: Store, messages: DataFrame, limits: Limits) -> dict:
    """Action. Applies one micro-batch (or any batch of messages) and publishes
    mirrors, report, ledger, open transactions and checkpoints together."""
    manifest = store.require()
    if manifest["working"]:
        raise Refused("window_open", "a window is staged; drain it before streaming")
    before = manifest["published"]["checkpoints"]
    # Staged once: parsed, counted, durable, and read back by every step below. What would be
    # refused is counted on that one write; only a log that has any is looked at again.
    count = lambda condition: F.count(F.when(condition, 1))
    starts = [(s, c["position"], c["log_start"]) for s, c in before.items() if c.get("log_start") is not None]
    too_early = F.lit(False)
    for source, position, start in starts:
        too_early |= (F.col("source") == source) & (F.col("commit_pos") < start)
    _, log, seen = store.keep("log", counted_bytes(messages.select(*ENVELOPE.fieldNames())), {
        "problems": count(domain_problem().isNotNull()), "outside": count(is_outside()), "early": count(too_early),
        "strangers": count(~F.col("source").isin(*before)) if before else F.count(F.lit(1))})
    if seen["problems"]:
        guard_log(log)
    if seen["outside"]:
        raise Refused("row_outside_transaction", f"a message of {rows_outside(log).first()['source']} has no position or number")
    if seen["strangers"]:
        unknown = log.filter(~F.col("source").isin(*before) if before else F.lit(True)).select("source").first()
        raise Refused("no_snapshot", f"{unknown['source']} has no snapshot; load it first")
    if seen["early"]:
        raise Refused("before_log_start", "a transaction lies before the one that was said to start its log; resnapshot")
    checkpoints = checkpoints_frame(store, manifest)
    waiting = store.pending(manifest)
    above = after_checkpoint(log, checkpoints)
    everything = above if waiting is None else waiting.unionByName(above)
    # One row per transaction, made once: guard, budget and readiness all go by it. Only a log that
    # holds a message twice is rid of copies and looked at for conflicts; payloads are not dealt for it.
    _, txns, told = store.keep("transactions-seen", counted_transactions(everything), {"copied": count(F.col("copies") > 1)})
    copied = told["copied"] > 0
    usage = txns.filter("_have > 0").select(*TXN, F.col("_have").alias("rows"), "bytes")
    fresh, before_it = (distinct_changes(everything), None) if copied else (above, waiting)

    def guard_transactions() -> None:
        faults = faults_of(txns, checkpoints)
        fault = any_row(faults.unionByName(conflicting_rows(everything)) if copied else faults)
        if fault is not None:
            raise Refused(fault["fault"], f"transaction {fault['commit_pos']} of {fault['source']}")

    # The new messages and those left open before, written once with what may be applied of them.
    done = F.col(READY)
    watched = {**open_metrics(before, ~done), "names": F.collect_set(F.when(done & (F.col("kind") == "row"), F.col("table_name"))),
               **{f"start_{s}": F.min(F.when(done & (F.col("source") == s) & F.col("kind").isin(*MARKS) & F.col("prev_pos").isNull(),
                                             F.col("commit_pos"))) for s in before}}
    _, judged, seen = together({
        "guard": guard_transactions, "budget": lambda: check_usage(usage, limits),
        "judged": lambda: store.keep("judged", with_ready(fresh, before_it, checkpoints, txns), watched)})["judged"]
    ready = judged.filter(READY).drop(READY)
    # One row per source.
    moved = {r["source"]: r for r in advance(checkpoints, batch_progress(ready)).collect()}
    ahead = {s: r for s, r in moved.items() if r["position"] > before[s]["position"]}
    pending_rows, pending_path = seen["rows"], None
    if pending_rows:
        pending_path, _, _ = store.keep("pending", judged.filter(~done).drop(READY))
    open_now = {"pending": pending_path, "pending_rows": pending_rows, "open": open_since(manifest, seen)}
    _check_waiting(open_now["open"], limits)
    published = copy.deepcopy(manifest["published"])
    if any(r["rows_applied"] > before[s]["rows_applied"] for s, r in ahead.items()):
        _apply(store, published, ready, sorted(seen["names"]), limits)
    begun = {s: seen[f"start_{s}"] for s in before if seen[f"start_{s}"] is not None}
    for source, now in ahead.items():
        published["checkpoints"][source] = {
            **before[source], "applied_at": utc_now(), "last_commit_at": _iso(now["last_commit_at"]),
            **{k: now[k] for k in ("position", "rows_applied", "batches_applied")},
            **({"log_start": begun[source]} if source in begun else {})}
    if not ahead and pending_rows == manifest.get("pending_rows", 0):
        return manifest
    return store.publish(manifest["version"], {**manifest, **open_now, "published": published})


def _check_waiting(waiting: dict, limits: Limits) -> None:
    """Refuses a transaction that has been open for longer than allowed."""
    for source, first in waiting.items():
        age = (datetime.now(timezone.utc) - as_time(first["since"])).total_seconds()
        if limits.open_seconds is not None and age > limits.open_seconds:
            raise Refused("transaction_open", f"transaction {first['position']} of {source} has waited for {age:.0f} s")


def _iso(value) -> str | None:
    # Spark hands timestamps out in the driver's zone; the manifest keeps UTC.
    return value.astimezone(timezone.utc).isoformat() if value else None


def _apply(store: Store, published: dict, ready: DataFrame, names: list[str], limits: Limits) -> None:
    """Action. Applies ``ready`` to the tables of ``published`` and records the buckets written."""
    tables = StoredTables(store, published["tables"])
    rows = split_key_changes(ready.filter(F.col("kind") == "row"))
    tables.apply(changes_of(tables, rows, names, limits, keep=lambda label, df: store.keep(label, df)[1]))


def start_stream(spark: SparkSession, store: Store, log_paths: str | list[str], checkpoint: str, limits: Limits,
                 descriptors: dict[str, SourceDescriptor] | None = None, trigger: dict | None = None,
                 files_per_trigger: int | None = None, facts: str | None = None) -> StreamingQuery:
    """Action. Starts the query. ``trigger`` is what ``DataStreamWriter.trigger``
    takes: ``{"availableNow": True}`` drains and stops (the default),
    ``{"processingTime": "30 seconds"}`` keeps following. After each batch that
    published, its facts are appended to the folder ``facts``."""
    if descriptors is not None:
        guard_start(store, descriptors, limits)
    log = read_change_log(spark, log_paths, streaming=True, files_per_trigger=files_per_trigger)
    return (log.writeStream.trigger(**(trigger or {"availableNow": True}))
            .option("checkpointLocation", checkpoint)
            .foreachBatch(lambda df, _: _run(store, df, limits, facts))
            .start())


def _run(store: Store, messages: DataFrame, limits: Limits, facts: str | None = None) -> None:
    before = store.require()
    after = sync_batch(store, messages, limits)
    if facts and after["version"] > before["version"]:
        write_facts(batch_facts(store, before, after), facts)


def run_for(query: StreamingQuery, seconds: float) -> None:
    """Action. Lets a continuous query run for a while, then stops it."""
    try:
        query.awaitTermination(seconds)
    finally:
        query.stop()
