"""Components against a plain union of ends, and how much work they take."""

import random

from mirrorfold.llm.components import components


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def found(spark, edges):
    return {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}


def test_odd_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(200, x) for x in range(130, 170)]
    edges += [(None, 3), (7, None), (5, 5), (-(1 << 63), (1 << 63) - 1), *[(300 + i, 301 + i) for i in range(5)]]
    edges += edges[:30] + [(b, a) for a, b in edges[:20]]
    assert found(spark, edges) == plain(edges)


def test_stars_take_no_round(spark):
    """What consists of stars already is seen to do so: one checkpoint and one look at the nodes."""
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 100) for i in range(1, 9)]
    context = spark.sparkContext
    context.setJobGroup("stars", "stars")
    try:
        assert found(spark, edges) == plain(edges)
        assert len(context.statusTracker().getJobIdsForGroup("stars")) <= 10
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
