"""The classifier: trees against plain recursion, held-out accuracy."""

import os
import zlib

import numpy as np
import pytest

from mirrorfold.llm import boosted_trees as b
from mirrorfold.llm.common import table
from tests.llm.cases import TEXTS, documents, labels

FOLDER = "/root/testdata/sf0.01"


def test_flat_traversal_is_recursion():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(b.STATISTICS)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = b.fit(x, y)
    inner = model.feature.shape[1]

    def walk(tree, row, node=0):
        if node >= inner:
            return model.value[tree, node - inner]
        return walk(tree, row, 2 * node + 1 + int(row[model.feature[tree, node]] > model.threshold[tree, node]))

    plain = [1 / (1 + np.exp(-(model.start + sum(walk(t, r) for t in range(len(model.feature)))))) for r in x]
    assert np.allclose(model.score(x), plain)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
def test_held_out_accuracy(spark):
    known = table(spark, FOLDER, "labels")
    rows = b.classify(table(spark, FOLDER, "documents"), known).join(known, "doc_id").filter("held_out").collect()
    assert len(rows) > 50
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95


def test_rows(spark):
    docs = documents(spark)
    for known in (labels(spark), labels(spark, [(4, 1, 0), (4, 0, 0), (9, 0, 1), (None, 1, 0), (8, None, 0)])):
        rows = b.classify(docs, known).collect()
        assert len(rows) == len(TEXTS) + 2
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert b.classify(docs.limit(0), labels(spark)).count() == 0
