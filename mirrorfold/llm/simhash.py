"""SimHash near-duplicates: fingerprints, links within a Hamming distance, groups.

A fingerprint bit is set where more than half the shingle hashes have it.
Fingerprints within ``DISTANCE`` bits of each other are found by pigeonhole:
the 64 bits are cut into ``BLOCKS`` blocks, so two close fingerprints agree on
at least ``BLOCKS - DISTANCE`` of them; each fingerprint is keyed once per
choice of that many blocks, keys are joined, and every candidate's Hamming
distance is checked. Equal fingerprints are one node from the start, so copies
never meet in a join.

A key that more than ``DENSE`` fingerprints share would give pairs in the
square of their number. Such a key is resolved exactly without pairs: each of
its fingerprints is dealt to the points one bit away on the bits outside the
key. Two fingerprints within two bits always meet at a point, all that meet
there are within two bits, and at most 33 can meet, so linking each to the
smallest at its point loses no component.

Texts without words (null, empty, blank) have the fingerprint zero and link
like any other. Null ids count as larger than all others. Repeated rows are
kept and share their group. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from mirrorfold.llm.common import fresh, map_texts
from mirrorfold.llm.components import components
from mirrorfold.session import cut_lineage

SHINGLE_WORDS = 3
DISTANCE = 2
BLOCKS = 4
DENSE = 32
SEED = 42

# Fixed value: lower case for A-Z alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def print_of(parts: Iterable[np.ndarray]) -> int:
    """The fingerprint of hashes, given in parts, as a signed 64-bit number; of none it is zero."""
    n, ones = 0, np.zeros(64, np.int64)
    for hashes in parts:
        n += len(hashes)
        ones += np.unpackbits(np.asarray(hashes, ">u8").view(np.uint8).reshape(-1, 64 // 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprint(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit number."""
    import xxhash

    found = text.encode().translate(LOWER).split()
    if not found:
        return 0
    if len(found) < words:
        found = [b" ".join(found)]
    elif words == 3:
        found = [b"%b %b %b" % x for x in zip(found, found[1:], found[2:])]
    else:
        found = [b" ".join(x) for x in zip(*(found[i:] for i in range(words)))]
    digest = xxhash.xxh64_intdigest
    return print_of(np.array([digest(x, seed) for x in found[start:start + (1 << 16)]], ">u8")
                    for start in range(0, len(found), 1 << 16))


def with_fingerprint(df: DataFrame, column: str = "fp", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    def make():
        return lambda texts: [pa.array([fingerprint(t, words) for t in texts], pa.int64())]

    return map_texts(df, make, [T.StructField(column, T.LongType())], text)


def _mask(blocks: tuple[int, ...]) -> int:
    width = 64 // BLOCKS
    value = sum(((1 << width) - 1) << (b * width) for b in blocks)
    return value - (1 << 64) if value >> 63 else value


def links(fingerprints: DataFrame) -> DataFrame:
    """``a, b`` (a < b) over the distinct values ``fp``: links within two bits whose
    components are those of all such links; where no key is dense, all links. *Action.*"""
    chosen = list(combinations(range(BLOCKS), BLOCKS - DISTANCE))
    keys = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_mask(c))).alias("key"))
                     for k, c in enumerate(chosen)])
    keyed = cut_lineage(fingerprints.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = keyed.join(sizes, ["t", "key"])
    few = shared.filter(F.col("n") <= DENSE).select("t", "key", "fp")
    other = few.withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = few.withColumnRenamed("fp", "a").join(other, ["t", "key"]).filter("a < b").filter(near).select("a", "b")

    free = F.lit(None).cast("array<bigint>")
    for k, c in enumerate(chosen):
        outside = [b for b in range(64) if not (_mask(c) >> b) & 1]
        flips = F.array(F.lit(0).cast("bigint"), *[F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("bigint")
                                                   for b in outside])
        free = F.when(F.col("t") == k, flips).otherwise(free)
    points = shared.filter(F.col("n") > DENSE).select("fp", "t", F.explode(free).alias("flip")).select(
        "fp", "t", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    met = points.groupBy("t", "point").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a < b")
    return pairs.union(stars).distinct()


def groups(df: DataFrame, doc_id: str = "doc_id", fp: str = "fp") -> DataFrame:
    """``fp, component_id, keeper_fp``: for each distinct fingerprint the smallest
    id of its group, and the fingerprint that goes with it. *Action.*"""
    nodes = cut_lineage(df.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("first_id")))
    roots = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    # A null id sorts behind all others.
    order = F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"), F.col("fp").alias("at"))
    least = rooted.groupBy("root").agg(F.min(order).alias("least"))
    return rooted.join(least, "root").select("fp", F.col("least.id").alias("component_id"), F.col("least.at").alias("keeper_fp"))


def hex_fingerprint(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every document. *Action.*"""
    marked = cut_lineage(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp"))
    return marked.join(groups(marked), "fp", "left").select(
        "doc_id", hex_fingerprint("fp").alias("fingerprint"), "component_id")


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates, columns unchanged: of each
    group the row with the smallest id stays, of its repeats one. *Action.*"""
    fp, key, rank = fresh(docs, "llm_fp"), fresh(docs, "llm_key"), fresh(docs, "llm_rank")
    marked = cut_lineage(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp"))

    def label(number, print_):
        return F.concat_ws(":", F.coalesce(number.cast("string"), F.lit("-")), print_.cast("string"))

    kept = groups(marked).filter("fp = keeper_fp").select(label(F.col("component_id"), F.col("fp")).alias(key))
    rows = with_fingerprint(docs, fp).withColumn(key, label(F.col("doc_id"), F.col(fp))).join(kept, key, "left_semi")
    # The key is nearly unique, and the join has dealt the rows by it already.
    order = Window.partitionBy(key).orderBy(F.xxhash64("text"), "text")
    return rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).select(*docs.columns)
