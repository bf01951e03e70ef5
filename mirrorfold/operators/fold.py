"""Net-change folds: many ordered changes of a key to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mirrorfold.contracts import Contract
from mirrorfold.functions.payload import field, has_field
from mirrorfold.operators.changes import change_order
from mirrorfold.operators.ordered import values_before
from mirrorfold.session import cut_lineage


def fold_rows(log: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The last change of every ``(table_name, row_id)``.

    ``max_by`` combines on the map side, so a hot key costs one partial row per
    task and never a sort of all its changes. ``reset`` says that a delete was
    among the folded changes, so what the key held before must not show through.
    """
    kept = keep if keep is not None else [c for c in ("payload", "commit_pos", "commit_ts") if c in log.columns]
    last = F.max_by(F.struct("action", *kept), change_order(log)).alias("_last")
    reset = F.max(F.col("action") == "D").alias("reset")
    folded = log.groupBy("table_name", "row_id").agg(last, reset, F.count(F.lit(1)).alias("changes"))
    return folded.select("table_name", "row_id", F.col("_last.action").alias("action"), "reset", "changes",
                         *[F.col(f"_last.{c}").alias(c) for c in kept])


def typed_changes(log: DataFrame, contract: Contract) -> DataFrame:
    """Changes of one table with typed columns: ``has_<c>`` and ``<c>``."""
    body = lambda c: (F.col("action") != "D") & has_field(F.col("payload"), c)
    columns = []
    for name in contract.values:
        columns.append(F.coalesce(body(name), F.lit(False)).alias(f"has_{name}"))
        columns.append(F.when(F.col("action") != "D", field(F.col("payload"), name, contract.type_of(name)))
                       .alias(name))
    order = ["commit_pos", "seq", *(["sub"] if "sub" in log.columns else [])]
    return log.filter(F.col("table_name") == contract.name).select(*order, "row_id", "action", *columns)


def fold_columns(log: DataFrame, contract: Contract) -> DataFrame:
    """Per key, the last value of each column that a change carried.

    Absent and null stay apart (``has_<c>`` with a null ``<c>`` is a null that
    was written). Changes before the last delete do not count.
    """
    return fold_typed(typed_changes(log, contract), contract)


def fold_typed(changes: DataFrame, contract: Contract) -> DataFrame:
    """:func:`fold_columns` over already typed changes."""
    order = change_order(changes)
    picks = [F.max_by("action", order).alias("action"),
             F.max(F.when(F.col("action") == "D", order)).alias("_deleted"),
             F.count(F.lit(1)).alias("changes")]
    for name in contract.values:
        value = F.when(F.col(f"has_{name}"), F.struct(order.alias("at"), F.col(name).alias("value")))
        picks.append(F.max_by(value, F.when(F.col(f"has_{name}"), order)).alias(f"_{name}"))
    folded = changes.groupBy("row_id").agg(*picks)
    out = [F.col("row_id"), F.col("action"), F.col("_deleted").isNotNull().alias("reset"), F.col("changes")]
    for name in contract.values:
        live = F.col(f"_{name}").isNotNull() & (
            F.col("_deleted").isNull() | (F.col(f"_{name}.at") > F.col("_deleted")))
        out.append(live.alias(f"has_{name}"))
        out.append(F.when(live, F.col(f"_{name}.value")).alias(name))
    return folded.select(*out)


def resolve_key_changes(split: DataFrame, current: DataFrame, contract: Contract) -> DataFrame:
    """Typed changes of one table in which a row that moved to another key also
    carries the columns its update left out, taken from the old key.

    ``split`` is the output of :func:`split_key_changes`. Runs jobs only when
    the log holds key changes. A row may move several times in one batch, so
    images are chained; each pass doubles the chain length already resolved.
    """
    order = ["commit_pos", "seq", "sub"]
    mine = split.filter(F.col("table_name") == contract.name)
    changes = typed_changes(mine, contract)
    moved = mine.filter((F.col("sub") == 2) & F.col("old_row_id").isNotNull()).select(*order, "row_id", "old_row_id")
    if moved.isEmpty():
        return changes
    at = F.struct(*order)
    kept = current.select(F.col(contract.key).alias("old_row_id"), *[
        F.struct(F.lit(True).alias("has"), F.col(c).alias("value")).alias(f"_m_{c}") for c in contract.values])
    # Walk every key that a row left: its changes, plus a probe where it left.
    probes = moved.select(F.col("commit_pos"), F.col("seq"), F.lit(0).alias("sub"),
                          F.col("old_row_id").alias("row_id"), F.lit("probe").alias("action"),
                          at.alias("_move"), F.col("row_id").alias("_new_id"))
    left = moved.select(F.col("old_row_id").alias("row_id")).distinct()
    walk = (changes.join(left, "row_id", "left_semi")
            .withColumn("_move", F.lit(None).cast("struct<commit_pos:bigint,seq:int,sub:int>"))
            .withColumn("_new_id", F.lit(None).cast("string")))
    probes = probes.select(*order, "row_id", "action", *[
        e for c in contract.values for e in (F.lit(False).alias(f"has_{c}"),
                                             F.lit(None).cast(contract.type_of(c)).alias(c))], "_move", "_new_id")
    # A probe sorts before the delete that removes its own key.
    walk = walk.unionByName(probes).withColumn("rank", F.when(F.col("action") == "probe", 0).otherwise(1))
    line = order + ["rank"]
    walk = walk.withColumn("_clear", F.when(F.col("action") == "D", F.struct(*order)))
    for c in contract.values:
        walk = walk.withColumn(f"_w_{c}", F.when(F.col(f"has_{c}"), F.struct(
            F.struct(*order).alias("at"), F.col(c).alias("value"))))
    walk = values_before(cut_lineage(walk), ["row_id"], line,
                         {"_cleared": "_clear", **{f"_b_{c}": f"_w_{c}" for c in contract.values}})
    images = walk.filter(F.col("action") == "probe")
    for c in contract.values:
        fresh = F.col(f"_b_{c}").isNotNull() & (
            F.col("_cleared").isNull() | (F.col(f"_b_{c}.at") > F.col("_cleared")))
        images = images.withColumn(f"_i_{c}", F.when(fresh, F.struct(
            F.lit(True).alias("has"), F.col(f"_b_{c}.value").alias("value"))))
    # Where the old key itself began with a move, that move's image comes first;
    # where nothing cleared it, the mirrored row does; after a delete, nothing.
    images = images.select(F.col("_move").alias("move"), F.col("row_id").alias("old_row_id"),
                           F.col("_cleared").alias("cleared"), *[f"_i_{c}" for c in contract.values])
    starts = moved.select(F.struct("commit_pos", "seq", F.lit(1).alias("sub")).alias("cleared"),
                          F.col("row_id").alias("old_row_id"), at.alias("parent"))
    images = images.join(starts, ["cleared", "old_row_id"], "left")
    images = images.join(kept, "old_row_id", "left")
    images = images.select("move", "parent", *[
        F.coalesce(F.col(f"_i_{c}"), F.when(F.col("cleared").isNull(), F.col(f"_m_{c}"))).alias(f"_i_{c}")
        for c in contract.values])
    images = cut_lineage(images)
    while not images.filter("parent is not null").isEmpty():
        older = images.select(F.col("move").alias("parent"), F.col("parent").alias("_up"),
                              *[F.col(f"_i_{c}").alias(f"_o_{c}") for c in contract.values])
        images = images.join(older, "parent", "left").select(
            "move", F.col("_up").alias("parent"),
            *[F.coalesce(f"_i_{c}", f"_o_{c}").alias(f"_i_{c}") for c in contract.values])
        images = cut_lineage(images)
    changes = changes.withColumn("move", F.struct(*order)).join(images.drop("parent"), "move", "left")
    out = []
    for c in contract.values:
        fill = ~F.col(f"has_{c}") & F.col(f"_i_{c}").isNotNull() & (F.col("action") != "D")
        out.append((F.col(f"has_{c}") | F.coalesce(fill, F.lit(False))).alias(f"has_{c}"))
        out.append(F.when(fill, F.col(f"_i_{c}.value")).otherwise(F.col(c)).alias(c))
    return changes.select(*order, "row_id", "action", *out)
