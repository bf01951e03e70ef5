"""Fingerprints and groups against brute force."""

import random
import re

import xxhash

from mirrorfold.llm import simhash
from tests.llm.cases import TEXTS, documents


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def plain_roots(prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    ordered = sorted(root)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1:]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_fingerprint():
    for text in TEXTS:
        assert simhash.fingerprint(text or "") == plain_fingerprint(text or "")


def test_xxhash_is_sparks(spark):
    row = spark.sql("select xxhash64('one two three') h").first()
    assert row["h"] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"one two three", 42)


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_groups_against_brute_force(spark):
    rng = random.Random(7)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for p in prints[:30]:  # chains of close prints
        for _ in range(4):
            p ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            prints.append(p)
    base = rng.getrandbits(64)  # dense: far more than DENSE prints share every key choice of the upper blocks
    prints += [base ^ (rng.getrandbits(14) & rng.getrandbits(14)) for _ in range(400)]
    rows = [(i, _signed(p)) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "doc_id bigint, fp bigint")
    roots = plain_roots([p for _, p in rows])
    least = {}
    for i, p in rows:
        least[roots[p]] = min(least.get(roots[p], i), i)
    found = {r["fp"]: r["component_id"] for r in simhash.groups(df).collect()}
    assert found == {p: least[roots[p]] for _, p in rows}


def test_rows(spark):
    docs = documents(spark)
    rows = simhash.near_duplicate_groups(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[0]["fingerprint"] == "0" * 16 and by_id[2]["component_id"] == 0
    assert by_id[4]["component_id"] == by_id[5]["component_id"] == 4
    kept = simhash.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({r["component_id"] for r in rows if r["component_id"] is not None})
    assert ids.count(None) == 1
    assert simhash.near_duplicate_groups(docs.limit(0)).count() == 0
