"""Running values and budget prefixes against brute force, hot keys included."""

import random

import pytest
from pyspark.sql import functions as F

import mirrorfold.operators.budgets as budgets
import mirrorfold.operators.ordered as ordered
from mirrorfold.operators.ordered import running_sums, values_before


def rows(seed, n=600):
    """A third of all rows have one key."""
    rng = random.Random(seed)
    out = [("hot" if i % 3 == 0 else f"k{rng.randint(0, 40)}", i // 4, i % 4, rng.randint(1, 9),
            rng.choice([None, None, i])) for i in range(n)]
    rng.shuffle(out)
    return out


SCHEMA = "k string, pos bigint, seq int, v bigint, w bigint"


@pytest.mark.parametrize("ranges", [1, 7, 150])
@pytest.mark.parametrize("keyed", [True, False])
def test_running_sums(spark, ranges, keyed):
    data = rows(1)
    got = running_sums(spark.createDataFrame(data, SCHEMA), ["pos", "seq"], {"s": F.col("v"), "n": F.lit(1)},
                       ["k"] if keyed else None, ranges).collect()
    sums, counts = {}, {}
    expected = set()
    for k, pos, seq, v, w in sorted(data, key=lambda r: r[1:3]):
        group = k if keyed else ""
        sums[group], counts[group] = sums.get(group, 0) + v, counts.get(group, 0) + 1
        expected.add((k, pos, seq, v, w, sums[group], counts[group]))
    assert {tuple(r) for r in got} == expected and len(got) == len(data)


@pytest.mark.parametrize("ranges", [1, 7, 150])
def test_values_before(spark, ranges):
    data = rows(2)
    got = values_before(spark.createDataFrame(data, SCHEMA), ["k"], ["pos", "seq"], {"p": "w", "q": "v"}, ranges)
    last_w, last_v, expected = {}, {}, set()
    for k, pos, seq, v, w in sorted(data, key=lambda r: r[1:3]):
        expected.add((k, pos, seq, v, w, last_w.get(k), last_v.get(k)))
        last_v[k], last_w[k] = v, w if w is not None else last_w.get(k)
    assert {tuple(r) for r in got.collect()} == expected


def test_ranges_follow_the_order_and_the_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 100)
    found = ordered.in_ranges(spark.createDataFrame(rows(3), SCHEMA), ["pos", "seq"]).collect()
    line = sorted(found, key=lambda r: (r["pos"], r["seq"]))
    assert [r["_range"] for r in line] == sorted(r["_range"] for r in found)
    assert 3 <= len({r["_range"] for r in found}) <= 6


def test_blocks_of_ranges_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 3)
    data = [(None if k == "hot" else k, *rest) for k, *rest in rows(6)]
    df = spark.createDataFrame(data, SCHEMA)
    whole = {tuple(r) for r in running_sums(df, ["pos", "seq"], {"s": F.col("v")}, None, 40).collect()}
    total = {r[-1] for r in whole}
    assert len(whole) == len(data) and max(total) == sum(r[3] for r in data)
    keyed = running_sums(df, ["pos", "seq"], {"s": F.col("v")}, ["k"], 40).filter("k is null").agg(F.max("s")).first()[0]
    assert keyed == sum(r[3] for r in data if r[0] is None)


@pytest.mark.parametrize("size", [60, 10**6])
def test_prefix_within(spark, monkeypatch, size):
    monkeypatch.setattr(ordered, "RANGE_ROWS", size)
    data = rows(4)
    df = spark.createDataFrame(data, SCHEMA)
    line = sorted(data, key=lambda r: r[1:3])
    for max_rows, max_bytes in ((0, 100), (1, 1000), (100, 10**9), (10**9, 1234), (10**9, 10**9), (599, 10**9)):
        expected, used = [], 0
        for n, r in enumerate(line):
            used += r[3]
            if n + 1 > max_rows or used > max_bytes:
                break
            expected.append(r)
        got = budgets.prefix_within(df, ["pos", "seq"], "v", max_rows, max_bytes).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1:3]) == expected, (max_rows, max_bytes)


def test_no_single_task_holds_the_order(spark):
    df = spark.createDataFrame(rows(5), SCHEMA)
    plan = running_sums(df, ["pos", "seq"], {"s": F.col("v")}, None, 7)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line.split("Window [")[1] for line in plan.splitlines() if "Window [" in line]
    # One window over the rows of a range, one over the ranges of a block, one over the blocks.
    over_rows = [w for w in windows if "_v_" in w]
    assert len(windows) == 3 and len(over_rows) == 1 and "_range" in over_rows[0].split("], [")[1]
