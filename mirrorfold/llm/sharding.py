"""Sharding by bytes: Karmarkar-Karp differencing over indivisible groups.

Equal keys form a group that stays whole. A partial partition is a tuple of
sums; differencing takes the two with the largest spread (largest minus
smallest sum), adds them in opposite order, and puts the result back, until
one is left. Groups are dealt at random to buckets of about ``bucket_groups``;
each bucket is differenced in its own task into ``PARTS`` parts, but for
``HELD`` of its groups, of sizes from all its range, which stay single. What
``FAN_IN`` buckets make is then differenced like groups, level by level, and
the last level makes the shards. So no task and not the driver ever sees all
groups, a group much larger than others is outweighed by the parts of all
buckets, and the single groups even out what parts are too coarse for. The
number of buckets follows the number of rows, all that the driver learns.

Null keys count as empty texts. Empty tables give empty results. Repeated rows
belong to one group. Null ids are placed like others and come first in slots.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from mirrorfold.llm.common import text_or_empty
from mirrorfold.session import cut_lineage

BUCKET_GROUPS = 20_000
PARTS = 256
HELD = 1024
FAN_IN = 16


def difference(sizes: np.ndarray, ways: int) -> np.ndarray:
    """The part, 0 to ``ways`` - 1, of each size, so that the sums of parts are near equal."""
    n = len(sizes)
    sums: list[np.ndarray | None] = [None] * n  # a single size is made a tuple when it is taken
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)

    def take() -> tuple[int, np.ndarray]:
        _, i = heapq.heappop(heap)
        held, sums[i] = sums[i], None
        if i < n:
            held = np.zeros(ways, np.int64)
            held[0] = sizes[i]
        return i, held

    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        (a, x), (b, y) = take(), take()
        total = x + y[::-1]
        rank = np.argsort(-total, kind="stable")
        made.append((a, b, rank.astype(np.int32)))
        total = total[rank]
        sums.append(total)
        heapq.heappush(heap, (int(total[-1] - total[0]), len(sums) - 1))
    # From the last combination down: the part of each position of a tuple.
    labels = {n + len(made) - 1: np.arange(ways, dtype=np.int32)}
    out = np.zeros(n, np.int32)
    for node in range(n + len(made) - 1, n - 1, -1):
        a, b, rank = made[node - n]
        at = np.empty(ways, np.int32)
        at[rank] = labels.pop(node)
        for child, places in ((a, at), (b, at[::-1])):
            if child < n:
                out[child] = places[0]
            else:
                labels[child] = places
    return out


def _held(pdf: pd.DataFrame) -> np.ndarray:
    """Places of the rows that stay single: of groups, or of the single groups of a level before."""
    free = np.flatnonzero(pdf["part"].to_numpy() >= PARTS) if "part" in pdf else np.arange(len(pdf))
    return free[np.unique(np.linspace(0, len(free) - 1, HELD).astype(np.int64))] if len(free) else free


def _step(shards: int, last: bool, key: list[str]):
    """Items of one node, named by ``key``, with the part or shard ``local`` of each."""
    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", *key], ascending=[False, *[True] * len(key)], kind="stable")
        sizes = pdf["size"].to_numpy(np.int64)
        if last:
            return pdf.assign(local=difference(sizes, shards))
        local, held = np.zeros(len(pdf), np.int32), _held(pdf)
        mixed = np.delete(np.arange(len(pdf)), held)
        local[held] = PARTS + np.arange(len(held))
        if len(mixed):
            local[mixed] = difference(sizes[mixed], PARTS)
        return pdf.assign(local=local)
    return step


def balanced_groups(groups: DataFrame, shards: int, buckets: int) -> DataFrame:
    """``digest, shard`` for ``groups(digest, size)``, the sizes of shards near equal. *Action.*"""
    dealt = groups.select("digest", "size", F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("node"))
    level = cut_lineage(dealt.groupBy("node").applyInPandas(
        _step(shards, buckets == 1, ["digest"]), "node bigint, digest string, size bigint, local int"))
    place = level.select("digest", "node", "local")
    while buckets > 1:
        items = level.groupBy(F.col("node").alias("child"), F.col("local").alias("part")).agg(F.sum("size").alias("size"))
        buckets = -(-buckets // FAN_IN)
        level = cut_lineage(items.withColumn("node", F.floor(F.col("child") / FAN_IN)).groupBy("node").applyInPandas(
            _step(shards, buckets == 1, ["child", "part"]), "node bigint, child bigint, part int, size bigint, local int"))
        moves = level.select(F.col("child").alias("node"), F.col("part").alias("local"), F.col("node").alias("above"),
                             F.col("local").alias("moved"))
        place = place.join(moves, ["node", "local"]).select(
            "digest", F.col("above").alias("node"), F.col("moved").alias("local"))
    return place.select("digest", F.col("local").alias("shard"))


def slots(df: DataFrame, shard: str, order: list[Column], spread: Column, parts: int) -> DataFrame:
    """``df`` with ``slot``, a gapless number from 0 in each shard. Rows are
    numbered in ``parts`` pieces of a shard, which small counts then link."""
    pieces = cut_lineage(df.withColumn("piece", F.pmod(spread, F.lit(parts)).cast("int")))
    counts = pieces.groupBy(shard, "piece").agg(F.count("*").alias("n"))
    before = counts.select(shard, "piece", (F.sum("n").over(Window.partitionBy(shard).orderBy("piece")) - F.col("n")).alias("base"))
    own = F.row_number().over(Window.partitionBy(shard, "piece").orderBy(*order)) - 1
    return pieces.withColumn("own", own).join(before, [shard, "piece"]).withColumn(
        "slot", (F.col("base") + F.col("own")).cast("bigint")).drop("piece", "own", "base")


def shard_documents(docs: DataFrame, shards: int = 16, bucket_groups: int = BUCKET_GROUPS) -> DataFrame:
    """Every document with its shard and slot; equal texts share a shard, and the
    shards' bytes are near equal. *Action.*"""
    text = text_or_empty()
    rows = cut_lineage(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.sha2(text, 256).alias("digest")))
    count = rows.count()
    buckets = max(1, -(-count // bucket_groups))
    placed = balanced_groups(rows.groupBy("digest").agg(F.sum("size").alias("size")), shards, buckets)
    # Copies of one text need not meet in one task: the join can be split.
    put = rows.join(placed, "digest").select("doc_id", "size", "text_crc32", "digest", "shard")
    numbered = slots(put, "shard", [F.col("doc_id"), F.col("digest")], F.xxhash64("doc_id", "digest"), 4 * buckets)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                           F.lit(None).cast("int").alias("grown_shard"))
