"""Benchmark decontamination: BM25 over an inverted index of test items.

Terms are pairs of adjacent words, lower case, without punctuation. A training
text is cut into overlapping passages, twice as long as the longest item and
half a passage apart, so any item lies whole in some passage. Each passage is
a query; an item's score is its BM25 score over the score that its own text
would get, 0 to 1. All items of at least ``SCORE`` are retrieved by block-max
WAND: postings are in blocks with their largest impact, and items whose bounds
cannot reach the score are skipped. A passage whose terms' largest impacts sum
to less than the score has no pivot at all; that first test is made for all
passages of a text at once. A hit counts if ``OVERLAP`` of the terms of the
item's question and of its answer occur in the passage.

The index holds test items only. It is cut into pieces of at most
``INDEX_BYTES`` of item text, so what is sent to the tasks is bounded; term
statistics are taken over all items in any case.

An item's text is question and answer in one: up to the last question mark
with words behind it, or else the first two thirds of its words, is the
question. Items or texts of fewer than two words (null and empty ones too)
never match. Repeated rows give repeated rows; null ids stay null.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from mirrorfold.llm.common import fresh, map_texts

SCORE = 0.5
OVERLAP = 0.5
K1, B = 1.2, 0.75
BLOCK = 8
INDEX_BYTES = 32 << 20

# Words are runs of ASCII letters, digits, "_" and other characters; common marks and spaces outside ASCII part words too.
_MARKS = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f]+")
_SPACED = bytes(b if chr(b).isalnum() or b == 95 or b >= 128 else 32 for b in range(256))
HIT = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType())]))
HIT_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()),
                                ("answer_overlap", pa.float64())]))


def words(text: str) -> list[bytes]:
    text = text.lower()
    return (text if text.isascii() else _MARKS.sub(" ", text)).encode().translate(_SPACED).split()


def split_item(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer."""
    before, mark, after = text.rpartition("?")
    if mark and words(before) and words(after):
        return words(before), words(after)
    found = words(text)
    cut = -(-2 * len(found) // 3)
    return found[:cut], found[cut:]


class Index:
    """Postings of some items, with statistics of all.

    ``items``: (id, text); ``df``: how many of all ``total`` items have a term;
    ``mean``: their mean number of terms.
    """

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int], total: int, mean: float):
        self.ids, self.parts, self.longest = [], [], 2
        vocabulary: dict[bytes, int] = {}
        postings: dict[int, list[tuple[int, float]]] = {}
        for item_id, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
            question, answer = split_item(text)
            found = [*question, *answer]
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in found]
            pairs = [(a << 32) | b for a, b in zip(ids, ids[1:])]
            if not pairs:
                continue
            times: dict[int, int] = {}
            for p, (a, b) in zip(pairs, zip(found, found[1:])):
                times[p] = times.get(p, 0) + 1
            idf = {p: float(np.log1p((total - df[b"%b %b" % (a, b)] + 0.5) / (df[b"%b %b" % (a, b)] + 0.5)))
                   for p, (a, b) in zip(pairs, zip(found, found[1:]))}
            weight = {p: idf[p] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(pairs) / mean)) for p, n in times.items()}
            own, k = sum(weight.values()), len(self.ids)
            for p, w in weight.items():
                postings.setdefault(p, []).append((k, w / own))
            cut = max(len(question) - 1, 0)
            self.ids.append(item_id)
            # A part of one word has no pair of its own: the pair at the joint stands for it.
            self.parts.append((set(pairs[:cut] or pairs[:1]), set(pairs[cut + 1:] or pairs[-1:])))
            self.longest = max(self.longest, len(found))
        self.vocabulary = vocabulary
        self.terms = np.array(sorted(postings), np.int64)
        self.items, self.impacts, self.lasts, self.tops, best = [], [], [], [], []
        for term in self.terms.tolist():
            found = postings[term]
            blocks = [found[i:i + BLOCK] for i in range(0, len(found), BLOCK)]
            self.items.append([k for k, _ in found])
            self.impacts.append([w for _, w in found])
            self.lasts.append([b[-1][0] for b in blocks])
            self.tops.append([max(w for _, w in b) for b in blocks])
            best.append(max(w for _, w in found))
        self.best = np.array(best)

    def wand(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """Items whose summed impacts over distinct ``terms`` (places in ``self.terms``) reach ``least``."""
        end = len(self.ids)
        cursors = [[self.items[t][0], 0, t] for t in terms]  # current item, its place, term
        out, slack = [], 1e-9
        while True:
            cursors = sorted(c for c in cursors if c[0] < end)
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += self.best[c[2]]
                if bound >= least - slack:
                    pivot = i
                    break
            if pivot < 0:
                return out
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, edge = 0.0, end
            for c in cursors[:pivot + 1]:
                b = bisect_left(self.lasts[c[2]], item)
                if b < len(self.lasts[c[2]]):
                    bound += self.tops[c[2]][b]
                    edge = min(edge, self.lasts[c[2]][b] + 1)
            if bound >= least - slack:
                if cursors[0][0] == item:
                    score = sum(self.impacts[c[2]][c[1]] for c in cursors[:pivot + 1])
                    if score >= least - slack:
                        out.append((item, score))
                    to = item + 1
                else:
                    to = item
            else:  # no item before the end of these blocks, or before the next cursor, can do
                to = max(item + 1, min(edge, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end))
            for c in cursors[:pivot + 1]:
                if c[0] < to:
                    held = self.items[c[2]]
                    c[1] = bisect_left(held, to, c[1])
                    c[0] = held[c[1]] if c[1] < len(held) else end

    def hits(self, text: str, score: float, overlap: float) -> list[dict]:
        """The items that a text holds, with the best score of its passages."""
        found = words(text)
        if len(found) < 2 or not len(self.terms):
            return []
        ids = np.fromiter(map(self.vocabulary.get, found, repeat(-1)), np.int64, len(found))
        places = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        pairs = (ids[places] << 32) | ids[places + 1]
        at = np.minimum(np.searchsorted(self.terms, pairs), len(self.terms) - 1)
        known = self.terms[at] == pairs
        places, at = places[known], at[known]
        step = self.longest
        starts = np.arange(0, max(len(found) - step, 1), step)
        total = np.concatenate(([0.0], np.cumsum(self.best[at])))
        low, high = np.searchsorted(places, starts), np.searchsorted(places, starts + 2 * step - 1)
        best: dict[int, dict] = {}
        for i in np.flatnonzero(total[high] - total[low] >= score - 1e-9).tolist():
            terms = np.unique(at[low[i]:high[i]])
            have = set(self.terms[terms].tolist())
            for item, reached in self.wand(terms.tolist(), score):
                question, answer = (len(p & have) / len(p) for p in self.parts[item])
                if min(question, answer) >= overlap and reached > best.get(item, {"score": 0.0})["score"]:
                    best[item] = {"item_id": self.ids[item], "score": min(reached, 1.0), "question_overlap": question,
                                  "answer_overlap": answer}
        return [best[k] for k in sorted(best)]


def indexes(benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> list[Index]:
    """The index of the test items in pieces of bounded size. *Action.*"""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))

    def terms(batches):
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                found = [w for part in split_item(text) for w in part]
                out.append([b"%b %b" % x for x in zip(found, found[1:])])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.binary()))], names=["terms"])

    listed = items.select("text").mapInArrow(terms, "terms array<binary>").filter(F.size("terms") > 0)
    size = items.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    stats = listed.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("mean")).first()
    counts = listed.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    pieces, made = max(1, -(-int(size) // index_bytes)), []
    for piece in range(pieces):
        own = items.filter(F.pmod(F.xxhash64("text"), F.lit(pieces)) == piece)
        mine = own.select("text").mapInArrow(terms, "terms array<binary>").select(F.explode("terms").alias("term")).distinct()
        df = {bytes(r["term"]): r["df"] for r in counts.join(mine, "term").collect()}
        made.append(Index([(r["item_id"], r["text"]) for r in own.collect()], df, stats["n"], stats["mean"] or 1.0))
    return made


def with_hits(docs: DataFrame, index: Index, column: str, score: float = SCORE, overlap: float = OVERLAP) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(index)

    def make():
        return lambda texts: [pa.array([held.value.hits(t, score, overlap) for t in texts], HIT_ARROW)]

    return map_texts(docs, make, [T.StructField(column, HIT)])


def leaks(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, overlap: float = OVERLAP,
          index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap`` for every document that holds a test item. *Action.*"""
    out = None
    for index in indexes(benchmark, index_bytes):
        found = with_hits(docs.select("doc_id", "text"), index, "hits", score, overlap).select(
            "doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
        out = found if out is None else out.union(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` that hold no test item, columns unchanged. *Action.*"""
    out = docs
    for index in indexes(benchmark):
        column = fresh(out, "hits")
        out = with_hits(out, index, column, score, overlap).filter(F.size(column) == 0).drop(column)
    return out
