"""Merkle manifest: equal to a plain tree, and proofs that fail for changed rows."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mirrorfold.llm import merkle
from mirrorfold.llm.queries import QUERIES
from tests.llm.cases import TEXTS, documents

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root, and per node its siblings level by level as (before, after)."""
    paths, spots = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, spot, n in zip(paths, spots, range(len(paths))):
            run = spot - spot % 3
            path.append(("".join(nodes[run:spot]), "".join(nodes[spot + 1:run + 3])))
            spots[n] = spot // 3
        nodes = [sha("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0] if nodes else None, paths


def plain(rows):
    """Per leaf in the order of parts and keys: source, doc_id, leaf, path, subroot, root."""
    parts = defaultdict(list)
    for r in rows:
        parts[r["source"]].append((r["doc_id"] is not None, r["doc_id"], leaf_of([r[f] for f in FIELDS])))
    names = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    subs = [tree([x[2] for x in sorted(parts[s], key=lambda x: (x[0], x[1] or 0, x[2]))]) for s in names]
    root, tops = tree([s[0] for s in subs])
    return [(s, key, leaf, path + top, sub, root) for s, (sub, paths), top in zip(names, subs, tops)
            for (_, key, leaf), path in zip(sorted(parts[s], key=lambda x: (x[0], x[1] or 0, x[2])), paths)]


def found(df):
    rows = merkle.manifest(df, FIELDS).collect()
    return sorted(((r["source"], r["doc_id"], r["leaf"], [tuple(p) for p in r["path"]], r["subroot"], r["root"]) for r in rows), key=repr)


@pytest.mark.parametrize("levels", [1, 2])
def test_many_rounds(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3 ** levels)
    sizes = {"hot": 100, "a": 1, "b": 3, "c": 4, "é": 9, "zz": 10, None: 28, "": 2, **{f"s{i}": 1 + i % 3 for i in range(14)}}
    rows = [(1000 * n + i, s, "en", i, f"text {i}\n") for n, (s, size) in enumerate(sizes.items()) for i in range(size)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars int, text string")
    assert found(df) == sorted(plain([dict(zip(df.columns, r)) for r in rows]), key=repr)


def test_odd_rows(spark):
    df = documents(spark).selectExpr("*", "1 as leaf", "2 as path", "3 as _part")
    assert found(df) == sorted(plain(df.collect()), key=repr)
    assert len(found(df)) == len(TEXTS) + 2
    assert found(df.limit(0)) == []
    one = df.filter("doc_id = 3")
    assert found(one) == [("s", 3, leaf_of([one.first()[f] for f in FIELDS]), [], leaf_of([one.first()[f] for f in FIELDS]),
                           leaf_of([one.first()[f] for f in FIELDS]))]


def test_changed_rows_fail(spark):
    rows = QUERIES["op12_merkle_manifest"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts) and len({r["root"] for r in rows}) == 1
    for r in rows:
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (texts[r["doc_id"]] or "")
        assert r["verified"] == (not changed)


def test_any_other_leaf_fails(spark):
    df = documents(spark, extra=False)
    other = merkle.digest_of([F.col("text")])
    rows = merkle.manifest(df, FIELDS, carried={"other": other})
    assert rows.filter(merkle.fold(F.col("other"), F.col("path")) == F.col("root")).count() == 0
    assert rows.filter(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
