"""Near copies of several lengths, verified similarity and large groups against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from mirrorfold.llm import near_copies
from mirrorfold.session import small_batches
from tests.llm.cases import documents


def plain_shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    a, b = plain_shingles(a), plain_shingles(b)
    return len(a & b) / len(a | b)


def plain_kept(rows):
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(rows)
    sets = {i: plain_shingles(rows[i]) for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def filler(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_stage_finds_near_copies(spark):
    rng = random.Random(3)
    rows, planted = {}, 0
    for length, changes in ((60, 1), (100, 1), (300, 3), (1000, 10), (1000, 20)):
        for _ in range(8):
            words = filler(rng, length)
            near = list(words)
            for at in rng.sample(range(5, length - 5), changes):
                near[at] = "changed"
            rows[len(rows)] = " ".join(words)
            rows[len(rows)] = " ".join(near)
            planted += similarity(rows[len(rows) - 2], rows[len(rows) - 1]) >= 0.8
            far = list(words)
            for at in range(0, length, 9):
                far[at] = "other"
            rows[len(rows)] = " ".join(far)
    expect = plain_kept(rows)
    assert planted >= 36 and len(expect) == len(rows) - planted
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == expect


@pytest.mark.parametrize("stars", [0, 1])
def test_large_groups(spark, monkeypatch, stars):
    """Copies at up to one changed word in twelve of one text: links through copies, not only through a center."""
    monkeypatch.setattr(near_copies, "STARS", stars)
    rng = random.Random(5)
    base, rows = filler(rng, 120), {}
    for i in range(90):
        own = list(base)
        for at in rng.sample(range(len(own)), rng.choice([1, 2, 3, 4])):
            own[at] = f"own{i}"
        rows[i] = " ".join(own)
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    assert {r["doc_id"] for r in near_copies.keep_one_of_each_group(df).collect()} == plain_kept(rows)


def test_similar_sets_share_a_prefix_key():
    """For any counts, sets of similarity 0.8 share a shingle of both prefixes."""
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 50, near_copies.SLOTS).astype(np.uint32)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 60)).astype(np.uint64))
        b = np.unique(np.concatenate((rng.permutation(a)[rng.integers(0, len(a) // 8 + 1):], rng.integers(0, 1 << 63, rng.integers(0, 5)).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        if both >= 0.8 * (len(a) + len(b) - both):
            x, y = (near_copies.in_order(v, counts)[:near_copies.prefix_length(len(v), 0.8)] for v in (a, b))
            assert len(np.intersect1d(x, y))


def test_a_common_passage_links_nothing(spark):
    """Half of each text is one passage: many keys in common, no similar pair, and few pairs compared."""
    rng = random.Random(8)
    passage = filler(rng, 40)
    rows = {i: " ".join(passage + filler(rng, 60)) for i in range(200)}
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    assert near_copies.keep_one_of_each_group(df).count() == 200


def test_odd_rows(spark):
    docs = documents(spark)
    out = near_copies.keep_one_of_each_group(docs)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == docs.columns and ids.count(None) == 1 and len(ids) == len(set(ids))
    assert {0, 3, 4} <= set(ids) and not {1, 2, 5} & set(ids)
    assert near_copies.keep_one_of_each_group(docs.limit(0)).count() == 0


def test_simhash_proposes_pairs(spark, tmp_path):
    """Texts whose prints are equal or within two bits are pairs of the SimHash step, others are not."""
    rng, hashes = random.Random(12), near_copies.WordHashes()

    def apart(a, b):
        return ((near_copies._print(a) ^ near_copies._print(b)) % (1 << 64)).bit_count()

    words = filler(rng, 400)
    texts = [" ".join(words), " ".join(filler(rng, 400)), " ".join(words).upper(), None, ""]
    sets = [near_copies.shingles(hashes.of(t or "")) for t in texts]
    nears = [" ".join([*words, f"more{i}"]) for i in range(100)]
    near = next(t for t in nears if 0 < apart(sets[0], near_copies.shingles(hashes.of(t))) <= 2)
    assert apart(sets[0], sets[1]) > 2 and near_copies._print(sets[4]) == 0
    rows = list(enumerate([*texts, near]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    near_copies.write_keys(docs, str(tmp_path / "keys"))
    found = near_copies.proposed(spark.read.parquet(str(tmp_path / "keys"))).collect()
    nodes = sorted(near_copies._node(s) for s in (sets[0], near_copies.shingles(hashes.of(near))))
    assert [[r["a"], r["b"]] for r in found] == [nodes]


def test_batches_are_small_within(spark):
    """The setting holds while near copies are sought, also where that fails, and not after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), small_batches(spark, 7):
        sizes = spark.range(100, numPartitions=1).mapInArrow(lambda batches: (
            pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n bigint").collect()
        assert max(r["n"] for r in sizes) == 7
        1 // 0
    assert spark.conf.get(name) == before


def test_shuffle_files_go_with_their_step(spark, monkeypatch):
    """While near copies are sought, shuffle files of an ended step are not kept until the driver collects garbage."""
    name, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    sought = near_copies.components

    def components(edges):
        seen.append(spark.conf.get(name, None))
        return sought(edges)

    before = spark.conf.get(name, None)
    monkeypatch.setattr(near_copies, "components", components)
    df = spark.createDataFrame([(i, f"one two three four five {i // 2}") for i in range(6)], "doc_id bigint, text string")
    assert near_copies.keep_one_of_each_group(df).count() == 3
    assert seen and set(seen) == {"true"} and spark.conf.get(name, None) == before
