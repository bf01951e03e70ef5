"""Counts against a plain version; bounds and choice of cutoffs."""

import re
from math import comb, inf

from mirrorfold.llm import quality_rules as q
from tests.llm.cases import TEXTS, documents, labels


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    hit = set()
    for i in range(len(words) - 4):
        for j in range(len(words) - 4):
            if i != j and words[i:i + 5] == words[j:j + 5]:
                hit |= set(range(i, i + 5))
                break
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(hit)


def test_counts():
    texts = [t or "" for t in TEXTS if len(t or "") < 14000] + [
        "a b c d e a b c d e f", "a a a a a a a", "p q r s t u p q r s t v q r s t u", "x\n x\nx\n\n\nx", "word " * 40]
    for text in texts:
        assert q.counts(text) == plain(text)


def test_lower_tail_is_exact():
    for k, n, p in ((0, 10, 0.1), (3, 40, 0.05), (7, 9, 0.5)):
        assert abs(q.lower_tail(k, n, p) - sum(comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-12


def test_choice():
    size = len(q.GRID) + 1
    clean, junk = [0] * size, [0] * size
    clean[1], junk[20] = 5000, 100
    assert q.choose(clean, junk) == q.GRID[19]
    few = [0] * size
    few[1] = 20
    assert q.choose(few, junk) == inf
    clean[20] = 400  # as many good texts as the bound forbids
    assert q.choose(clean, junk) == inf
    assert q.choose([0] * size, [0] * size) == inf


def test_false_rejection_is_limited():
    """Over repeated draws a cutoff that loses too many good texts is hardly ever certified."""
    import random
    rng, size, risk = random.Random(5), len(q.GRID) + 1, q.ALPHA / len(q.RULES)
    wrong = 0
    for _ in range(200):
        good, bad = [0] * size, [0] * size
        lost = sum(rng.random() < 1.05 * risk for _ in range(2000))
        good[-1], good[0], bad[-1] = lost, 2000 - lost, 10 ** 6
        wrong += q.choose(good, bad) < inf
    assert wrong <= 2


def test_rows(spark):
    docs = documents(spark)
    rows = q.judge(docs, labels(spark, [(5, 1, 0), (6, 0, 0), (6, 1, 0), (None, 1, 0), (7, None, 0)])).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r["doc_id"] is not None:
            found = plain(TEXTS[r["doc_id"]] or "") if len(TEXTS[r["doc_id"]] or "") < 14000 else None
            if found:
                assert tuple(r[c] for c in q.COUNTS) == found
            assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
            assert r["kept"] == (not r["base_failed"])
    kept = q.keep_good(docs, labels(spark))
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)
    assert q.judge(docs.limit(0), labels(spark)).count() == 0


def test_a_rule_takes_effect(spark):
    good = "plain words that say something about nothing at all today"
    texts = [(i, f"{good} {i}", "en") for i in range(1500)] + [(5000 + i, f"{good.replace(' ', '### ')} {i}", "en") for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    known = labels(spark, [(i, int(i < 5000), 0) for i, _, _ in texts if i % 3 or i >= 5000])
    kept = {r["doc_id"] for r in q.judge(docs, known).filter("kept").collect()}
    assert kept == set(range(1500))
