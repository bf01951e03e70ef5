"""Near copies: texts whose sets of five-word shingles have Jaccard similarity 0.8 or more.

Words are lower-cased (A-Z) runs without ASCII white space. First comes SimHash:
every set has a print of 64 bits, prints within ``simhash.DISTANCE`` bits are
found by blocks, and the pairs they propose are checked on their whole sets. That
alone is not enough: at similarity 0.8 prints differ in some ten bits, and
blocks short enough for that distance say nothing. So the pairs whose prints lie
further apart come from prefixes of the whole sets, which miss none: with all
shingles in one order, two sets of similarity s share one of the first
``n - ceil(s * n) + 1`` shingles of either. The order is from rare to common, by
a sketch of counts of ``SLOTS`` slots over all texts, so a line that many texts
share is in no prefix, and a text with a fifth of its own words finds no one.

Texts with equal sets are one node. The nodes that share a prefix key are compared
with one of them, the node made of the commonest shingles, which copies with few
changes all resemble; for ``STARS`` rounds with a new centre outside the largest
component of the key. What a key then still holds in different components is
compared pair by pair, as far as lengths and places in the prefix allow enough
shingles in common. So components are those of all similar pairs, and pairs
stay few where a key holds copies of one text. A pair is compared once: by the
number of prefix keys in common, which rules out most that are not similar, and
then on its whole sets; a set travels only if its node is in such a pair.

Texts without words are one group. Null ids count as larger than all others;
repeated rows count once. Equal scores take the smaller node as centre. Texts of
any length are handled whole. Helper columns take names the table does not have.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from mirrorfold.llm import simhash
from mirrorfold.llm.common import CHUNK, fresh, map_texts, text_or_empty
from mirrorfold.llm.components import components
from mirrorfold.llm.fuzzy_passages import SEED, WordHashes, _mixed
from mirrorfold.session import cut_lineage, scratch, shuffles_dropped, small_batches

WORDS = 5
SIMILARITY = 0.8
SLOTS = 1 << 18  # of the sketch; what the driver gets and sends is this many counts
ASKED_BITS = 1 << 26  # of the filter that says which sets travel
KEY_BITS = 1 << 27  # and of the one that says which keys do
STARS = 1

_PRIME = np.uint64(0x100000001B3)


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """The distinct hashes, in order, of the runs of ``size`` words; a shorter text is one run."""
    size = min(size, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    runs = np.zeros(n, np.uint64)
    for j in range(size):
        runs = runs * _PRIME + words[j:j + n]
    return np.unique(_mixed(runs))


def prefix_length(size: int, similarity: float) -> int:
    """How many of a set's shingles, in the common order, any similar set must share one of."""
    return size - math.ceil(similarity * size - 1e-9) + 1 if size else 0


def in_order(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shingles from rare to common, by the sketch and then by hash."""
    return found[np.lexsort((found, counts[found & np.uint64(len(counts) - 1)]))]


def _node(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


def _print(found: np.ndarray) -> int:
    return simhash.print_of(found[start:start + (1 << 16)] for start in range(0, len(found), 1 << 16))


def _with_node(df: DataFrame, column: str, words: int = WORDS) -> DataFrame:
    """``df`` with the node of its text."""
    def make():
        hashes = WordHashes()
        return lambda texts: [pa.array([_node(shingles(hashes.of(t), words)) for t in texts], pa.int64())]

    return map_texts(df, make, [T.StructField(column, T.LongType())])


def _sets(docs: DataFrame, words: int, schema: str, rows) -> DataFrame:
    """What ``rows(ids, sets)`` makes of the shingle sets of a chunk of documents."""
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                made = rows(part.column(0), [shingles(hashes.of(t), words) for t in part.column(1).to_pylist()])
                if made is not None:
                    yield made

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)


def shingle_counts(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """The sketch: how many texts hold a shingle of each slot. *Action.*"""
    def run(batches):
        hashes, counts = WordHashes(), np.zeros(SLOTS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                found = shingles(hashes.of(text.as_py()), words)
                slots, n = np.unique((found & np.uint64(SLOTS - 1)).astype(np.int64), return_counts=True)
                counts[slots] += n
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(counts[slots])], names=["slot", "n"])

    rows = docs.select(text_or_empty().alias("text")).mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    found = rows.toArrow()
    counts = np.zeros(SLOTS, np.uint32)
    counts[found["slot"].to_numpy()] = np.minimum(found["n"].to_numpy(), 2**32 - 1)
    return counts


def write_keys(docs: DataFrame, folder: str, words: int = WORDS, similarity: float = SIMILARITY) -> None:
    """Action. A head row (place -1, the key is the print of the set) for every document, and for every
    shingle of its prefix a row with the key, its place, the size of the set and how common its shingles are."""
    shared = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, words))

    def rows(ids, sets):
        counts, out = shared.value, [[], [], [], [], []]
        for found in sets:
            ordered, n = in_order(found, counts), prefix_length(len(found), similarity)
            common = int(counts[found & np.uint64(SLOTS - 1)].mean()) if n else 0
            out[0].append(np.full(n + 1, _node(found)))
            out[1].append(np.concatenate((np.array([_print(found)]), ordered[:n].view(np.int64))))
            out[2].append(np.arange(-1, n))
            out[3].append(np.full(n + 1, len(found)))
            out[4].append(np.full(n + 1, common))
        node, key, place, size, common = map(np.concatenate, out)
        heads = np.flatnonzero(place < 0)
        at = np.full(len(place), len(ids))
        at[heads] = np.arange(len(ids))
        known = pa.concat_arrays([ids, pa.nulls(1, ids.type)]).take(pa.array(at))
        return pa.RecordBatch.from_arrays(
            [pa.array(node), pa.array(key), pa.array(place, pa.int32()), pa.array(size, pa.int32()), pa.array(common), known],
            names=["node", "key", "place", "size", "common", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    _sets(docs, words, f"node bigint, key bigint, place int, size int, common bigint, doc_id {kind}", rows).write.parquet(folder)


def _similar(threshold: float):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                keep = []
                for x, y in zip(part.column(2), part.column(3)):
                    x, y = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= threshold * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _bits(rows: DataFrame, column: str, size: int):
    """Broadcast: a bit for every value of the column by its last bits. *Action.*"""
    slot = F.pmod(column, F.lit(size)) + 1  # these functions count from 1
    # Values are dealt out before their bits are put together: a task's own part of every bitmap would be larger than they are.
    dealt = rows.select(F.bitmap_bucket_number(slot).alias("at"), F.bitmap_bit_position(slot).alias("bit")).repartition("at")
    found = dealt.groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for r in found.collect():
        part = np.frombuffer(r["bits"], np.uint8)
        start = (r["at"] - 1) * len(part)
        bits[start:start + len(part)] = part[:len(bits) - start]
    return rows.sparkSession.sparkContext.broadcast(bits)


def _is_set(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    slots = values % (8 * len(bits))
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The rows ``key, node, place, size, common`` of keys that several nodes have. *Action.* Only
    keys and the two ends of their nodes are shuffled for all; of the rows, those that a filter
    of fixed size lets through."""
    keys = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    keys = cut_lineage(keys.filter("least <> most").select("key"))
    shared = _bits(keys, "key", KEY_BITS)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_is_set(shared.value, batch.column(0).to_numpy())))

    near = keyed.mapInArrow(run, keyed.schema)
    return cut_lineage(near.join(keys, "key", "left_semi").dropDuplicates(["key", "node"]))


def proposed(keyed: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs ``a, b`` of nodes that SimHash proposes, of sizes that allow the similarity: those of one
    print meet its smallest node, and so do the smallest nodes of prints within ``simhash.DISTANCE`` bits. *Action.*"""
    heads = cut_lineage(keyed.filter("place < 0").select("node", F.col("key").alias("fp"), "size").distinct())
    first = heads.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("first"))
    near = simhash.links(first.select("fp"))
    met = heads.join(first, "fp").select("node", "size", F.col("first.node").alias("centre"), F.col("first.size").alias("other_size"))
    ends = near.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b")
    met = met.union(ends.select("x.node", "x.size", "y.node", "y.size"))
    return met.filter("node <> centre").filter(_enough(similarity)).select(
        F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b"))


def prefixes(shared: DataFrame) -> DataFrame:
    """``node, size, keys``: the keys of a node that others have too. *Action.*"""
    return cut_lineage(shared.groupBy("node", "size").agg(F.collect_list("key").alias("keys")))


def plausible(pairs: DataFrame, mine: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs that may be similar by how many of their prefix keys they share; ``mine`` is of
    :func:`prefixes`. *Action.* What two sets share beyond the prefixes lies behind the prefix that ends first."""
    both = pairs.join(mine.toDF("a", "x", "i"), "a").join(mine.toDF("b", "y", "j"), "b").select(
        "a", "b", "x", "y", F.size(F.array_intersect("i", "j")).alias("k"))
    rest = F.greatest(*[F.ceil(F.col(c) * similarity - 1e-9) - 1 for c in ("x", "y")])
    enough = (F.col("k") + rest) * (1 + similarity) >= (F.col("x") + F.col("y")) * (similarity - 1e-9)
    return cut_lineage(both.filter((F.col("k") > 0) & enough).select("a", "b"))


def asked_sets(pairs: DataFrame, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``node, found`` for the nodes of the pairs, and few others. *Action.* A filter of
    fixed size says which nodes are asked for; it can only let too many through."""
    shared = _bits(pairs.select(F.explode(F.array("a", "b")).alias("node")), "node", ASKED_BITS)

    def rows(ids, sets):
        nodes = np.array([_node(s) for s in sets], np.int64)
        keep = np.flatnonzero(_is_set(shared.value, nodes))
        if len(keep):
            return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array([sets[i].view(np.int64) for i in keep], pa.list_(pa.int64()))],
                                              names=["node", "found"])

    made = _sets(docs, words, "node bigint, found array<bigint>", rows)
    return cut_lineage(made.groupBy("node").agg(F.first("found").alias("found")))


def verified(pairs: DataFrame, docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs ``a, b`` of nodes whose whole shingle sets are similar. *Action.*"""
    sets = asked_sets(pairs, docs, words)
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return cut_lineage(both.mapInArrow(_similar(similarity), "a bigint, b bigint"))


def _enough(similarity: float, with_places: bool = False):
    """Whether two sets can be similar by their sizes, and by the places at which they share a key."""
    x, y = F.col("size"), F.col("other_size")
    fits = F.least(x, y) >= F.greatest(x, y) * (similarity - 1e-9)
    if with_places:
        # For two given sizes the prefixes that must share a key are shorter than for any partner.
        needed = F.ceil((x + y) * similarity / (1 + similarity) - 1e-9)
        fits &= (F.col("place") <= x - needed) & (F.col("other_place") <= y - needed)
    return fits


def linked(keyed: DataFrame, docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``node, root`` of the nodes of similar pairs: the components of all such pairs, from the rows
    ``node, key, place, size, common`` of all prefixes. *Action.* Nodes found later are linked to the roots found before."""
    shared = shared_keys(keyed.filter("place >= 0").select("key", "node", "place", "size", "common"))
    rows = prefixes(shared)
    typical = F.struct(F.col("common"), (-F.col("node")).alias("order"), F.col("node").alias("centre"), F.col("size").alias("other_size"))
    centres = shared.groupBy("key").agg(F.max(typical).alias("c")).select("key", "c.centre", "c.other_size")
    pair = [F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")]
    met = shared.join(centres, "key").filter("node <> centre").filter(_enough(similarity))
    checked = plausible(proposed(keyed, similarity).union(met.select(*pair)).distinct(), rows, similarity)
    roots = components(verified(checked, docs, words, similarity))
    for turn in range(STARS + 1):
        placed = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        counts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
        main = counts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("roots")).filter("roots > 1")
        # Only keys whose nodes are in several components say anything new.
        shared = cut_lineage(placed.join(main.select("key", F.col("m.root").alias("main")), "key"))
        rest = shared.filter("root <> main")
        if turn < STARS:
            other = rest.groupBy("key").agg(F.max(F.struct(*[typical, F.col("root")])).alias("c")).select(
                "key", F.col("c.col1.centre").alias("centre"), F.col("c.col1.other_size").alias("other_size"), F.col("c.root").alias("other"))
            met = shared.join(other, "key").filter(_enough(similarity))
        else:
            other = rest.select("key", F.col("node").alias("centre"), F.col("place").alias("other_place"),
                                F.col("size").alias("other_size"), F.col("root").alias("other"))
            met = shared.join(other, (shared["key"] == other["key"]) & (shared["root"] != other["other"]) & _enough(similarity, True))
        met = met.filter("root <> other").select(*pair).distinct()
        new = plausible(met.join(checked, ["a", "b"], "left_anti"), rows, similarity)
        if not new.isEmpty():
            roots = components(roots.toDF("a", "b").union(verified(new, docs, words, similarity)))
            checked = checked.union(new)
        shared = shared.drop("root", "main")
    return roots


def keep_one_of_each_group(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near copies, columns unchanged: of each group
    the row with the smallest id stays, of its repeats one. *Action.*"""
    node, key, rank = fresh(docs, "llm_node"), fresh(docs, "llm_key"), fresh(docs, "llm_rank")
    folder = scratch(docs.sparkSession, "near-copies")
    with shuffles_dropped(docs.sparkSession), small_batches(docs.sparkSession):  # a row holds a text, or two whole sets
        write_keys(docs, folder, words, similarity)
        keyed = docs.sparkSession.read.parquet(folder)
        found = linked(keyed, docs, words, similarity)
    nodes = keyed.filter("place < 0").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    roots = found.withColumnRenamed("node", "at")
    rooted = nodes.join(roots, F.col("node") == F.col("at"), "left").select("node", F.coalesce("root", "node").alias("root"), "first_id")
    # A null id sorts behind all others.
    order = F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"), F.col("node").alias("at"))
    least = rooted.groupBy("root").agg(F.min(order).alias("least"))

    def label(number, at):
        return F.concat_ws(":", F.coalesce(number.cast("string"), F.lit("-")), at.cast("string"))

    kept = least.select(label(F.col("least.id"), F.col("least.at")).alias(key))
    rows = _with_node(docs, node, words).withColumn(key, label(F.col("doc_id"), F.col(node))).join(kept, key, "left_semi")
    # The key is nearly unique, and the join has dealt the rows by it already.
    chosen = Window.partitionBy(key).orderBy(F.xxhash64("text"), "text")
    return rows.withColumn(rank, F.row_number().over(chosen)).filter(F.col(rank) == 1).select(*docs.columns)
