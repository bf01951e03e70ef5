"""Periodic runs: equal to looking at every period of every text."""

import hashlib
import random
import re
import zlib

import pytest

from mirrorfold.llm import periodic
from mirrorfold.llm.queries import QUERIES, with_planted_runs
from tests.llm.cases import TEXTS, documents


def brute(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q) and i > start:
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def some_words(rng):
    n, kind = rng.randrange(260), rng.randrange(8)
    if kind < 2:
        return [rng.choice("ab" if kind else "abcdefgh") for _ in range(n)]
    if kind == 2:  # regions of one small period, side by side
        unit, words = [rng.choice("ab") for _ in range(rng.randrange(1, 6))], []
        while len(words) < n:
            words += unit * rng.randrange(1, 30)
            words = words[:len(words) - rng.randrange(len(unit))] + (["c"] if rng.random() < 0.2 else [])
        return words
    if kind == 3:  # a long period to the end
        a, p = rng.randrange(n + 1), rng.randrange(1, 60)
        words = [str(rng.randrange(1000)) for _ in range(n)]
        return [words[min(a + (i - a) % p, n - 1)] if i >= a else w for i, w in enumerate(words)]
    if kind == 4:
        x, y = ["a"], ["a", "b"]
        while len(y) < n:
            x, y = y, y + x
        return y[:n]
    if kind == 5:  # a long period that is itself periodic but for its border
        unit = ["a", "b"] * rng.randrange(1, 40) + ["a"]
        return ["x"] * rng.randrange(3) + unit * rng.randrange(2, 6) + ["y"] * rng.randrange(2) + unit * 2
    if kind == 6:
        words = []
        for _ in range(4):
            words = words * 2 + [rng.choice("abc")] * rng.randrange(12)
        return (words * 2)[:600]
    return [str(i) for i in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_equals_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = [some_words(rng) for _ in range(rng.randrange(1, 8))]
        found = periodic.runs_of_texts([" ".join(t).encode() for t in texts])
        for words, (_, runs) in zip(texts, found):
            assert runs.tolist() == [list(r) for r in brute(words)], words


def test_long_text():
    rng = random.Random(9)
    unit = [str(rng.randrange(10 ** 6)) for _ in range(30_000)]
    words = ["a"] + unit * 2 + unit[:500] + ["z"] + ["q"] * 20_000
    (_, runs), = periodic.runs_of_texts([" ".join(words).encode()])
    assert runs.tolist() == [[1, 60_500, 30_000], [60_502, 20_000, 1]]


def test_wrong_hashes_are_seen(monkeypatch):
    """Where hashes say equal and words do not, the words decide."""
    words = [str(i) for i in range(40)] + ["s", "t", "u"] * 9
    found = periodic._checked(periodic.np.array([hash(w) % 1000 for w in words]), periodic.np.array([[2, 67, 3]]))
    assert found.tolist() == [[40, 67, 3]]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = (1 if doc_id is None else zlib.crc32(str(doc_id).encode())), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_over_a_table(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(some_words(rng))) for i in range(400)] + [(400 + i, t) for i, t in enumerate(TEXTS)]
    rows += [(None, "a b c " * 5), rows[3], rows[3]]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()]
    order = lambda r: (r[0] is None, r)
    assert sorted(found, key=order) == sorted((expected(*r) for r in rows), key=order)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 20


def test_odd_rows(spark):
    df = documents(spark).selectExpr("*", "'extra' as runs", "1 as collapsed")
    out = periodic.periodic_runs(df)
    assert out.columns == [*df.columns, "_runs", "_collapsed"]
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 2 and all(r["runs"] == "extra" for r in rows)
    many = next(r for r in rows if (r["text"] or "").startswith("word word"))
    assert [tuple(x) for x in many["_runs"]] == [(0, 3000, 1)] and many["_collapsed"] == "word"
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    assert with_planted_runs(df.limit(0)).count() == 0
