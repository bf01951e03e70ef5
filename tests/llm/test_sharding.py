"""Shards: whole groups, near equal bytes, gapless slots."""

import random
import zlib
from collections import defaultdict

import numpy as np

from mirrorfold.llm import sharding
from tests.llm.cases import TEXTS, documents


def test_differencing_beats_greedy():
    rng = np.random.default_rng(3)
    sizes = rng.lognormal(7, 1, 3000).astype(np.int64)
    sums = np.bincount(sharding.difference(sizes, 16), sizes, 16)
    greedy = np.zeros(16)
    for s in sorted(sizes, reverse=True):
        greedy[greedy.argmin()] += s
    assert sums.max() - sums.min() <= np.ptp(greedy)
    assert sharding.difference(sizes[:1], 16).tolist() == [0]


def check(rows, texts, spread):
    by_shard, home = defaultdict(list), {}
    for r in rows:
        text = (texts(r) or "").encode()
        assert r["size"] == len(text) + 1 and r["text_crc32"] == zlib.crc32(text) and r["law"] == "bytes"
        assert home.setdefault(text, r["shard"]) == r["shard"]
        by_shard[r["shard"]].append(r)
    for held in by_shard.values():
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    sums = [sum(r["size"] for r in held) for held in by_shard.values()]
    assert len(by_shard) == 16 and max(sums) - min(sums) <= spread


def test_many_buckets_and_levels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FAN_IN", 3)
    rng = random.Random(1)
    texts = ["w" * rng.randrange(1, 400) + str(rng.randrange(1500)) for _ in range(3000)] + ["copy"] * 300
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    check(sharding.shard_documents(df, bucket_groups=200).collect(), lambda r: texts[r["doc_id"]], 60)


def test_large_group_is_outweighed_by_all_buckets(spark):
    """A group of nearly a whole shard, larger than a shard's share of its bucket."""
    rng = random.Random(2)
    texts = ["w" * rng.randrange(1, 400) + str(rng.randrange(1500)) for _ in range(3000)] + ["c" * 399] * 80
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    check(sharding.shard_documents(df, bucket_groups=500).collect(), lambda r: texts[r["doc_id"]], 400)


def test_rows(spark):
    rows = sharding.shard_documents(documents(spark)).collect()
    assert len(rows) == len(TEXTS) + 2
    assert len({r["shard"] for r in rows if r["doc_id"] in (0, 1)}) == 1
    assert sharding.shard_documents(documents(spark).limit(0)).count() == 0
