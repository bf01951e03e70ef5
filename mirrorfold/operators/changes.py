"""The change log before it is folded: decoding, key changes, transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mirrorfold.functions.text import is_uuid, normal_id, utf8_bytes
from mirrorfold.operators.ordered import values_before

# Fixed value: bytes counted per change on top of its payload.
ENVELOPE_BYTES = 128
TXN = ["source", "commit_pos"]
MARKS = ("commit", "heartbeat")
READY = "_ready"
# A marker made here sorts behind all rows of its transaction.
END_SEQ = 2**31 - 1


def change_order(df: DataFrame):
    """The order of changes within one source."""
    return F.struct("commit_pos", "seq", *(["sub"] if "sub" in df.columns else []))


def decode_changes(raw: DataFrame, require_uuid: bool = True) -> tuple[DataFrame, DataFrame]:
    """Raw messages (``payload`` as JSON text) to ``(changes, rejected)``.

    A delete keeps nothing but its id, because the other fields of a key-only
    delete are placeholders and not values. Unchanged large columns are simply
    missing from the JSON and stay missing.
    """
    parsed = raw.withColumn("_json", F.try_parse_json("payload"))
    decoded = (parsed
               .withColumn("row_id", F.coalesce(F.try_variant_get("_json", "$.id", "string"), F.col("row_id")))
               .withColumn("byte_count", utf8_bytes(F.col("payload")) + ENVELOPE_BYTES))
    good_id = is_uuid(F.col("row_id")) if require_uuid else F.col("row_id").isNotNull()
    reason = (F.when(F.col("payload").isNotNull() & F.col("_json").isNull(), "not_json")
              .when(~good_id, "unsupported_id"))
    judged = decoded.withColumn("reason", reason).withColumn("row_id", normal_id(F.col("row_id")))
    only_id = F.parse_json(F.to_json(F.struct(F.col("row_id").alias("id"))))
    changes = (judged.filter("reason is null")
               .withColumn("payload", F.when(F.col("action") == "D", only_id).otherwise(F.col("_json")))
               .drop("_json", "reason"))
    rejected = judged.filter("reason is not null").drop("_json")
    return changes, rejected


def counted_bytes(log: DataFrame) -> DataFrame:
    """The log with its own count of bytes per row, whatever its producer said."""
    own = utf8_bytes(F.coalesce(F.to_json("payload"), F.lit(""))) + ENVELOPE_BYTES
    return log.withColumn("byte_count", F.when(F.col("kind") == "row", own).cast("bigint"))


def split_key_changes(log: DataFrame) -> DataFrame:
    """An update that moves a row to another key becomes delete old, clear new,
    write new. ``sub`` orders the parts; other changes keep ``sub`` 0."""
    moved = F.col("old_row_id").isNotNull() & (F.col("old_row_id") != F.col("row_id")) & (F.col("action") != "D")
    part = lambda sub, action, key: F.struct(
        F.lit(sub).alias("sub"), action.alias("action"), key.alias("row_id"))
    parts = F.when(moved, F.array(part(0, F.lit("D"), F.col("old_row_id")),
                                  part(1, F.lit("D"), F.col("row_id")),
                                  part(2, F.col("action"), F.col("row_id")))
                   ).otherwise(F.array(part(0, F.col("action"), F.col("row_id"))))
    rest = [c for c in log.columns if c not in ("action", "row_id", "payload", "sub")]
    return (log.withColumn("_part", F.explode(parts))
            .select(*rest, F.col("_part.sub").alias("sub"), F.col("_part.action").alias("action"),
                    F.col("_part.row_id").alias("row_id"),
                    F.when(F.col("_part.action") != "D", F.col("payload")).alias("payload")))


def after_checkpoint(log: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Changes above their source's checkpoint; the rest is a replay, since a
    checkpoint only moves over transactions that were whole (:func:`committed_only`).
    Messages without a position are not let through here; refuse them first.

    ``checkpoints`` has one row per source, so it is broadcast.
    """
    known = F.broadcast(checkpoints.select("source", F.col("position").alias("_position")))
    return (log.join(known, "source", "left")
            .filter(F.col("commit_pos") > F.coalesce("_position", F.lit(-1).cast("bigint")))
            .drop("_position").select(*log.columns))


def distinct_changes(log: DataFrame) -> DataFrame:
    """One copy of each message; a file or topic may deliver it twice."""
    return log.dropDuplicates(["source", "commit_pos", "seq", "kind"])


def commit_markers(log: DataFrame) -> DataFrame:
    """One row per committed transaction: its commit marker or heartbeat."""
    return (log.filter(F.col("kind").isin(*MARKS)).groupBy(*TXN)
            .agg(F.max("commit_ts").alias("_commit_ts")))


def with_marks(log: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """A whole log of rows with a commit marker behind every transaction, or
    those of ``marked(source, commit_pos)``. *Action.*"""
    keys = log.groupBy(*TXN).agg(F.max("commit_ts").alias("commit_ts"), F.count(F.lit(1)).alias("txn_rows"))
    chained = values_before(keys, ["source"], ["commit_pos"], {"prev_pos": "commit_pos"})
    marks = (chained if marked is None else chained.join(marked, TXN, "left_semi")).withColumns(
        {"kind": F.lit("commit"), "seq": F.lit(END_SEQ)})
    return log.unionByName(marks, allowMissingColumns=True)


def transactions(log: DataFrame, **more: Column) -> DataFrame:
    """One row per transaction: whether it is marked, its rows, what its marker says, and the aggregates ``more``."""
    mark = F.col("kind").isin(*MARKS)
    none = F.lit(None).cast("bigint")
    said = F.when(F.col("kind") == "heartbeat", F.coalesce(F.col("txn_rows"), F.lit(0))).otherwise(
        F.col("txn_rows")) if "txn_rows" in log.columns else none
    before = F.col("prev_pos") if "prev_pos" in log.columns else none
    # Two markers that differ have two digests; least and greatest need no list of them.
    end = F.when(mark & (F.col("kind") == "commit"), F.xxhash64(
        F.col("commit_ts").isNull(), "commit_ts", said.isNull(), said, before.isNull(), before))
    return log.groupBy(*TXN).agg(
        F.max(mark).alias("_marked"), F.count(F.when(F.col("kind") == "row", 1)).alias("_have"),
        F.max(F.when(mark, said)).alias("_want"), F.max(F.when(mark, before)).alias("_prev"),
        (F.min(end) != F.max(end)).alias("_torn"),
        F.max(F.when(F.col("kind") == "commit", F.col("seq"))).alias("_end"),
        F.max(F.when(F.col("kind") == "row", F.col("seq"))).alias("_last"), F.count(F.lit(1)).alias("messages"),
        *[c.alias(name) for name, c in more.items()])


def counted_transactions(log: DataFrame) -> DataFrame:
    """:func:`transactions` of a log that may hold copies of a message: those count once, and ``copies``
    says how many a message has at most. Also the bytes of its rows, and the time of its marker.
    No payload is read, so it is small next to the log."""
    slim = ["commit_ts", "txn_rows", "prev_pos", "byte_count"]
    once = log.groupBy(*TXN, "seq", "kind").agg(*[F.first(c).alias(c) for c in slim], F.count(F.lit(1)).alias("copies"))
    return transactions(once, copies=F.max("copies"), bytes=F.sum(F.when(F.col("kind") == "row", F.col("byte_count"))),
                        _commit_ts=F.max(F.when(F.col("kind").isin(*MARKS), F.col("commit_ts"))))


def committed_only(log: DataFrame, pending: DataFrame | None = None,
                   checkpoints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Splits into ``(ready, still_open)`` by :func:`with_ready`; both keep the envelope columns."""
    judged = with_ready(log, pending, checkpoints)
    return judged.filter(READY).select(*log.columns), judged.filter(~F.col(READY)).select(*log.columns)


def with_ready(log: DataFrame, pending: DataFrame | None = None, checkpoints: DataFrame | None = None,
               txns: DataFrame | None = None) -> DataFrame:
    """All messages, old open ones and new, with ``_ready``: whether their transaction may be applied.

    A transaction is ready when its marker is there, all the rows that the
    marker counts are there, and the chain of markers leads from it to the
    checkpoint (or to the start of the log, where none is given) without a gap
    and over ready transactions alone. So changes apply in log order, whatever
    order they arrive in, and what lies at or below a checkpoint was applied.
    Markers of ready transactions are part of ``ready``: they move the
    checkpoint, also for a heartbeat without rows. ``txns`` are the :func:`counted_transactions`
    of all messages, where they are known already; without copies among them none are looked for.
    """
    if txns is None:
        everything = log if pending is None else distinct_changes(pending.unionByName(log))
        txns, markers = transactions(everything), commit_markers(everything)
    else:
        everything = log if pending is None else pending.unionByName(log)
        markers = txns.filter("_marked").select(*TXN, "_commit_ts")
    if checkpoints is None:
        start = txns.groupBy("source").agg((F.min("commit_pos") - 1).alias("_start"))
    else:
        start = checkpoints.select("source", F.col("position").alias("_start"))
    # One row per source.
    chained = txns.join(F.broadcast(start), "source", "left").filter(
        F.col("_marked") & (F.col("_prev") > F.coalesce("_start", F.lit(-1).cast("bigint"))))
    gaps = chained.join(txns.select("source", F.col("commit_pos").alias("_prev")), ["source", "_prev"], "left_anti")
    unready = txns.filter(~F.col("_marked") | (F.col("_have") < F.col("_want"))).select(*TXN).unionByName(gaps.select(*TXN))
    floor = unready.groupBy("source").agg(F.min("commit_pos").alias("_floor"))
    floored = everything.join(F.broadcast(floor), "source", "left")
    is_ready = F.col("_floor").isNull() | (F.col("commit_pos") < F.col("_floor"))
    # A row takes the time of its commit marker. Every transaction below the
    # floor has one, and markers are few next to rows.
    return (floored.withColumn(READY, is_ready).drop("_floor").join(markers, TXN, "left")
            .withColumn("commit_ts", F.when(F.col(READY), F.coalesce("_commit_ts", "commit_ts")).otherwise(F.col("commit_ts")))
            .select(*log.columns, READY))


def is_outside() -> Column:
    """A row without a position or sequence number, or a marker without a position."""
    return F.col("commit_pos").isNull() | (F.col("seq").isNull() & F.coalesce(F.col("kind") == "row", F.lit(False)))


def rows_outside(log: DataFrame) -> DataFrame:
    return log.filter(is_outside())


def conflicting_rows(log: DataFrame) -> DataFrame:
    """Different rows under one position and number, in the form of :func:`transaction_faults`.
    Equal ones are copies that a file or topic delivered twice."""
    told = [c for c in ("table_name", "action", "row_id", "old_row_id") if c in log.columns]
    body = [F.to_json("payload")] if "payload" in log.columns else []
    digest = F.xxhash64(*told, *body)
    twice = (log.filter("kind = 'row' and commit_pos is not null and seq is not null").groupBy(*TXN, "seq")
             .agg(F.min(digest).alias("_a"), F.max(digest).alias("_b"), F.count(F.lit(1)).alias("_n")).filter("_a <> _b"))
    return twice.groupBy(*TXN).agg(F.lit("conflicting_rows").alias("fault"), F.sum("_n").alias("messages"))


def transaction_faults(log: DataFrame, checkpoints: DataFrame | None = None) -> DataFrame:
    """Messages that break the transaction protocol: ``(source, commit_pos, fault, messages)``.

    With ``checkpoints``, markers that do not prove their transaction whole
    and in its place are faults too. A marker that names none before it says that
    the log starts there: only the first transaction of a source may, and only
    while its checkpoint is the start of the log.
    """
    faults = faults_of(transactions(log.filter(F.col("commit_pos").isNotNull())), checkpoints)
    outside = rows_outside(log).groupBy(*TXN).agg(F.count(F.lit(1)).alias("messages"))
    return faults.unionByName(outside.withColumn("fault", F.lit("row_outside_transaction")))


def faults_of(per_txn: DataFrame, checkpoints: DataFrame | None = None) -> DataFrame:
    """:func:`transaction_faults` of the rows of :func:`transactions`."""
    found = [F.when(F.col("_torn"), F.lit("conflicting_commit")),
             F.when(F.col("_last") > F.col("_end"), F.lit("row_after_commit")),
             F.when(F.col("_have") > F.col("_want"), F.lit("rows_beyond_count"))]
    if checkpoints is not None:
        # One row per source.
        first = per_txn.groupBy("source").agg(F.min("commit_pos").alias("_first"))
        per_txn = per_txn.join(F.broadcast(checkpoints.select("source", "position")), "source", "left").join(
            F.broadcast(first), "source", "left")
        found += [F.when(F.col("_marked") & F.col("_want").isNull(), F.lit("marker_without_count")),
                  F.when(F.col("_marked") & F.col("_prev").isNull() & (
                      (F.col("position") > 0) | (F.col("commit_pos") > F.col("_first"))), F.lit("marker_without_chain")),
                  F.when(F.col("_marked") & (F.col("_prev") >= F.col("commit_pos")), F.lit("marker_without_chain"))]
    return per_txn.select(*TXN, F.explode(F.array_distinct(F.array_compact(F.array(*found)))).alias("fault"), "messages")
