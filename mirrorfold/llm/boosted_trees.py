"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text are binned by quantiles; each tree is grown level
by level from histograms of gradients. Finished trees are complete binary
trees in flat arrays (feature, threshold, value), so that all trees of all
rows of a batch descend one level per numpy step.

The model is fitted on at most ``TRAIN_ROWS`` labelled documents, those with
the smallest hash of their id; that bound is a parameter and also bounds what
the driver collects. Every document is scored in full.

Null and empty texts have zero statistics and are scored like any other text.
Conflicting labels count by majority, ties as good; null labels or ids teach
nothing. Without labels of both kinds the score is their smoothed share. Rows
with a null id are scored and not held out. Repeated rows each get a row.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from mirrorfold.llm.common import map_texts

TRAIN_ROWS = 20_000
TREES = 60
DEPTH = 4
BINS = 64
RATE = 0.15
L2 = 1.0
MIN_WEIGHT = 1.0
THRESHOLD = 0.7

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digits": range(48, 58), "high": range(128, 256),
    "spaces": (9, 10, 11, 12, 13, 32), "stops": b".,;:", "shouts": b"!?", "symbols": b"#*$%&|<>", "quotes": b"\"'()[]{}",
    "other": b"/\\=+-_@^~`",
}
_CLASS_OF = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_bytes), _k] = 1
STATISTICS = [*_CLASSES, "log_words", "word_bytes", "distinct_words", "top_word", "distinct_triples", "repeated_lines",
              "line_words", "longest_word", "packed", "plain_words"]


def statistics(text: str) -> list[float]:
    data = text.encode()
    size = max(len(data), 1)
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS_OF / size
    words = data.split()
    n = max(len(words), 1)
    times = Counter(words)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    triples = max(len(words) - 2, 1)
    return [
        *shares, np.log1p(len(words)), sum(map(len, words)) / n, len(times) / n, max(times.values(), default=0) / n,
        len(set(zip(words, words[1:], words[2:]))) / triples, (len(lines) - len(set(lines))) / max(len(lines), 1),
        min(n / max(len(lines), 1), 1000.0), min(max(map(len, times), default=0), 1000), len(zlib.compress(data, 1)) / size,
        sum(c for w, c in times.items() if w.isalpha()) / n]


@dataclass
class Model:
    """``feature`` and ``threshold`` have a row per tree and an entry per inner
    node, ``value`` an entry per leaf; the children of node i are 2i+1, 2i+2."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        total = np.full(len(x), self.start)
        if trees:
            at, row, tree = np.zeros((len(x), trees), np.int64), np.arange(len(x))[:, None], np.arange(trees)[None, :]
            while at[0, 0] < inner:
                at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
            total += self.value[tree, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Model:
    n, width = x.shape if len(x) else (0, len(STATISTICS))
    inner = 2 ** depth - 1
    share = (y.sum() + 1) / (n + 2)
    start = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Model(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    offset = np.arange(width) * BINS
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    value, margin = np.zeros((trees, inner + 1)), np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess, node = p - y, p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            count = 2 ** level
            local = node - (count - 1)
            cell = ((local * width * BINS)[:, None] + offset[None, :] + binned).ravel()
            shape = (count, width, BINS)
            g, h = (np.bincount(cell, np.repeat(v, width), count * width * BINS).reshape(shape).cumsum(axis=2) for v in (grad, hess))
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g ** 2 / (h + L2) + (all_g - g) ** 2 / (all_h - h + L2) - all_g ** 2 / (all_h + L2)
            gain[(h < MIN_WEIGHT) | (all_h - h < MIN_WEIGHT)] = -np.inf
            best = gain.reshape(count, -1).argmax(axis=1)
            for c in range(count):
                f, b = divmod(int(best[c]), BINS)
                if gain[c, f, b] > 1e-6 and b < len(edges[f]):
                    feature[t, count - 1 + c], threshold[t, count - 1 + c] = f, edges[f][b]
            right = x[np.arange(n), feature[t, node]] > threshold[t, node]
            node = 2 * node + 1 + right
        leaf = node - inner
        g, h = (np.bincount(leaf, v, inner + 1) for v in (grad, hess))
        value[t] = -RATE * g / (h + L2)
        margin += value[t, leaf]
    return Model(start, feature, threshold, value)


def with_statistics(df: DataFrame, column: str, text: str = "text") -> DataFrame:
    def make():
        return lambda texts: [pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))]

    return map_texts(df, make, [T.StructField(column, T.ArrayType(T.DoubleType()))], text)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits on the ``rows`` labelled documents of smallest id hash. *Action.*"""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    voted = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).cast("int").alias("label"))
    # At most `rows` rows of two numbers, so the broadcast has that bound.
    chosen = F.broadcast(voted.orderBy(*order).limit(rows))
    known = with_statistics(docs.select("doc_id", "text").join(chosen, "doc_id"), "x")
    sample = known.select("doc_id", "x", "label").orderBy(*order, "x").limit(rows).toPandas()
    x = np.array(sample["x"].tolist()) if len(sample) else np.zeros((0, len(STATISTICS)))
    return fit(x, sample["label"].to_numpy(np.float64))


def score(df: DataFrame, model: Model, column: str = "score", text: str = "text") -> DataFrame:
    def make():
        return lambda texts: [pa.array(model.score(np.array([statistics(t) for t in texts])), pa.float64())]

    return map_texts(df, make, [T.StructField(column, T.DoubleType())], text)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Score and class of every document; held-out labels are not learned. *Action.*"""
    model = train(docs, labels.filter(~held_out()), rows)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
