"""Merkle manifest of a table: one digest over all rows, and a proof for each.

Every row is a leaf, the digest of its fields. Leaves of one part (one source)
stand in order of their key; every ``ARITY`` neighbours become their digest
until one is left, the part's root. The parts' roots, in order of the part,
become the table's root in the same way. Digests are SHA-256 as hex text.

A level of ``BLOCK`` aligned nodes is one string of fixed-width digests: fixed
width substrings of it are the runs whose digests make the next level, and the
substrings that flank a node in its run are its siblings. A block climbs
``LEVELS`` levels by itself; the digests that blocks end with are the nodes of
the next round, so a part of ``n`` rows takes ``log n / log BLOCK`` rounds and
no task ever holds more than a block. Siblings come down the same way: a block
learns its own way to the root once, and every row's way is made inside its
block, so none is shuffled. Only digests travel, never a text.

A null field is marked as such and differs from an empty one. A null part is a
part, the first; a null key comes first in it. Equal keys are ordered by their
leaves, and equal rows are leaves each. Texts of any length are hashed where
they lie. A table without rows gives none. Only the named columns are read, so
extra ones cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mirrorfold.operators.ordered import running_sums
from mirrorfold.session import cut_lineage, scratch

ARITY = 3
LEVELS = 5
BLOCK = ARITY ** LEVELS
WIDTH = 64  # characters of a digest
NO_PATH = "cast(array() as array<struct<before:string,after:string>>)"


def digest_of(fields: list[Column]) -> Column:
    """Digest of a row's fields, each with its length in bytes before it."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to, by its siblings level by level."""
    return F.aggregate(path, leaf, lambda node, side: F.sha2(F.concat(side.before, node, side.after), 256))


def siblings(path: Column) -> Column:
    """All siblings of a way to the root as one text."""
    return F.array_join(F.transform(path, lambda side: F.concat(side.before, side.after)), "")


def manifest(docs: DataFrame, fields: list[str], key: str = "doc_id", part: str = "source",
             carried: dict[str, Column] | None = None) -> DataFrame:
    """``key, part, leaf, path, subroot, root`` and the ``carried`` columns of every row. *Action.*

    ``path`` lists, level by level up to the root, the siblings before and
    after the node in its run. ``carried`` are columns made from the row.
    """
    spark, carried = docs.sparkSession, carried or {}
    folder = scratch(spark, "leaves")
    docs.select(F.col(part).alias("_part"), F.col(key).alias("_key"), digest_of([F.col(f) for f in fields]).alias("_node"),
                *[c.alias(f"_with_{name}") for name, c in carried.items()]).write.parquet(folder)
    leaves = spark.read.parquet(folder)
    placed = running_sums(leaves, ["_part", "_key", "_node"], {"_place": F.lit(1)}, keys=["_part"])
    rounds = _climb(placed.withColumn("_place", F.col("_place") - 1), leaves.groupBy("_part").agg(F.count("*").alias("_count")))
    tops = [r.filter(f"_count <= {BLOCK}").select("_part", F.col("_root").alias("_node")) for r in rounds]
    tops = cut_lineage(reduce(DataFrame.unionByName, tops))

    # the parts' roots are the nodes of one more tree
    parts = running_sums(tops, ["_part"], {"_place": F.lit(1)}).select(
        F.lit(0).alias("_part"), F.col("_part").alias("_of"), "_node", F.col("_place") - 1)
    parts = cut_lineage(parts.toDF("_part", "_of", "_node", "_place"))
    above = _climb(parts, parts.groupBy("_part").agg(F.count("*").alias("_count")))
    root = above[-1].filter(f"_count <= {BLOCK}").select("_part", F.col("_root").alias("_top"))
    ways = _rows_with_ways(_with_ways_up(above), ["_part"]).join(root, "_part").select(
        F.col("_rows._of").alias("_part"), F.col("_rows._node").alias("_sub"), F.col("_way").alias("_rest"), "_top")

    held = _match(_with_ways_up(rounds), cut_lineage(ways), ["_part"])
    rows = _rows_with_ways(held.withColumn("_up", F.concat("_up", "_rest")), ["_part", "_sub", "_top"])
    return rows.select(F.col("_rows._key").alias(key), F.col("_part").alias(part), F.col("_rows._node").alias("leaf"),
                       F.col("_way").alias("path"), F.col("_sub").alias("subroot"), F.col("_top").alias("root"),
                       *[F.col(f"_rows._with_{name}").alias(name) for name in carried])


def _match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which null equals null."""
    other = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
    return left.join(other, [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys], "left").drop(*[f"_r{k}" for k in keys])


def _climb(nodes: DataFrame, counts: DataFrame) -> list[DataFrame]:
    """Blocks of every round, bottom up: ``_part, _block, _count`` (nodes of the
    part in this round), ``_rows`` in order, ``_levels, _steps, _root``. *Action.*"""
    rounds = []
    while True:
        held = [c for c in nodes.columns if c not in ("_part", "_place")]
        blocks = nodes.groupBy("_part", F.floor(F.col("_place") / BLOCK).alias("_block")).agg(
            F.sort_array(F.collect_list(F.struct("_place", *held))).alias("_rows"))
        blocks = _match(blocks, counts, ["_part"])
        level = F.array_join(F.col("_rows._node"), "")
        blocks = blocks.withColumn("_l0", level).withColumn(
            "_steps", sum((F.col("_count") > ARITY ** k).cast("int") for k in range(LEVELS)))
        for k in range(LEVELS):
            blocks = blocks.withColumn(f"_l{k + 1}", F.expr(
                f"if(_steps > {k}, array_join(transform(sequence(1, length(_l{k}), {ARITY * WIDTH}), "
                f"p -> sha2(substring(_l{k}, p, {ARITY * WIDTH}), 256)), ''), null)"))
        levels = F.array(*[f"_l{k}" for k in range(LEVELS + 1)])
        blocks = cut_lineage(blocks.select("_part", "_block", "_count", "_rows", "_steps", levels.alias("_levels")))
        blocks = blocks.withColumn("_root", F.expr("element_at(_levels, _steps + 1)"))
        rounds.append(blocks)
        most = counts.agg(F.max("_count")).first()[0] or 0
        if most <= BLOCK:
            return rounds
        more = blocks.filter(f"_count > {BLOCK}")
        nodes = more.select("_part", F.col("_block").alias("_place"), F.col("_root").alias("_node"))
        counts = counts.filter(f"_count > {BLOCK}").select("_part", F.ceil(F.col("_count") / BLOCK).alias("_count"))


def _rows_with_ways(blocks: DataFrame, kept: list[str]) -> DataFrame:
    """A row per node of the blocks: ``_rows`` and ``_way``, its siblings up to the root."""
    at = f"cast(i div array({', '.join(str(ARITY ** k) for k in range(LEVELS))})[k] as int)"
    way = (f"concat(transform(slice(_levels, 1, _steps), (l, k) -> struct("
           f"substring(l, {WIDTH} * ({at} - {at} % {ARITY}) + 1, {WIDTH} * ({at} % {ARITY})) as before, "
           f"substring(l, {WIDTH} * ({at} + 1) + 1, {WIDTH} * ({ARITY - 1} - {at} % {ARITY})) as after)), _up)")
    return blocks.select(*kept, F.explode(F.expr(f"transform(_rows, (x, i) -> struct(x as r, {way} as w))")).alias("_x")).select(
        *kept, F.col("_x.r").alias("_rows"), F.col("_x.w").alias("_way"))


def _with_ways_up(rounds: list[DataFrame]) -> DataFrame:
    """The lowest blocks with ``_up``, the way from each block's root to its part's root."""
    up = None
    for blocks in reversed(rounds):
        known = F.lit(None) if up is None else F.col("_up")
        blocks = blocks if up is None else _match(blocks, up, ["_part", "_block"])
        blocks = blocks.withColumn("_up", F.coalesce(known, F.expr(NO_PATH)))
        up = _rows_with_ways(blocks, ["_part"]).select(
            "_part", F.col("_rows._place").alias("_block"), F.col("_way").alias("_up"))
    return blocks
