"""Hits against a plain BM25 over every passage and item."""

import random
from math import log1p

import pytest

from mirrorfold.llm import decontamination as d
from tests.llm.cases import TEXTS, documents


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def plain_hits(items, text, score=d.SCORE, overlap=d.OVERLAP):
    """Every item that some passage of ``text`` reaches, by summing all terms."""
    terms = {}
    for i, t in items:
        q, a = d.split_item(t or "")
        found = [*q, *a]
        if len(found) > 1:
            terms[i] = (list(zip(found, found[1:])), len(q), len(found))
    n, mean = len(terms), sum(len(t) for t, _, _ in terms.values()) / max(len(terms), 1)
    df = {}
    for pairs, _, _ in terms.values():
        for p in set(pairs):
            df[p] = df.get(p, 0) + 1
    step = max([2, *(n for _, _, n in terms.values())])
    words, out = d.words(text), {}
    for start in range(0, max(len(words) - step, 1), step):
        passage = words[start:start + 2 * step]
        have = set(zip(passage, passage[1:]))
        for i, (pairs, cut, _) in terms.items():
            def weight(p):
                tf = pairs.count(p)
                return log1p((n - df[p] + 0.5) / (df[p] + 0.5)) * tf * (d.K1 + 1) / (
                    tf + d.K1 * (1 - d.B + d.B * len(pairs) / mean))
            reached = sum(weight(p) for p in set(pairs) & have) / sum(map(weight, set(pairs)))
            parts = [set(pairs[:max(cut - 1, 0)] or pairs[:1]), set(pairs[max(cut - 1, 0) + 1:] or pairs[-1:])]
            if reached >= score - 1e-9 and min(len(x & have) / len(x) for x in parts) >= overlap:
                out[i] = max(out.get(i, 0), min(reached, 1))
    return out


def test_wand_against_plain(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xy")  # few words, so that items share terms
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 20)))) for i in range(120)]
    items += [(200, items[3][1]), (201, "What is it? it is this"), (202, ""), (203, None)]
    docs = []
    for i in range(60):
        text = [word() for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            own = (rng.choice(items)[1] or "").split()
            own = [w if rng.random() < 0.9 else word() for w in own]
            at = rng.randrange(len(text) + 1)
            text[at:at] = own
        docs.append((i, " ".join(text)))
    rows = d.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), items_of(spark, items)).collect()
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in rows}
    plain = {(i, k): s for i, t in docs for k, s in plain_hits(items, t).items()}
    assert found.keys() == plain.keys() and len(found) > 20
    assert all(found[k] == pytest.approx(plain[k]) for k in plain)


def test_pieces_of_the_index_change_nothing(spark):
    items = [(i, f"item number {i} asks for the colour of box {i * 7} and says it is green{i}") for i in range(40)]
    docs = spark.createDataFrame([(i, f"before it. {items[i][1].upper()}! after") for i in range(0, 40, 3)], "doc_id bigint, text string")
    whole = sorted(map(tuple, d.leaks(docs, items_of(spark, items)).collect()))
    assert whole == sorted(map(tuple, d.leaks(docs, items_of(spark, items), index_bytes=500).collect()))
    assert {(r[0], r[1]) for r in whole} >= {(i, i) for i in range(0, 40, 3)}


def test_rows(spark):
    docs = documents(spark)
    items = items_of(spark, [(1, "said, once more here: same text twice"), (2, TEXTS[6]), (3, None), (None, "x")])
    found = {(r["doc_id"], r["item_id"]) for r in d.leaks(docs, items).collect()}
    # Item 1 has the sentence's halves in the other order, so all its pairs but one.
    assert found == {(4, 1), (5, 1), (6, 2)} and d.leaks(docs, items).count() == 4
    kept = d.without_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert d.leaks(docs, items.limit(0)).count() == 0 and d.leaks(docs.limit(0), items).count() == 0
