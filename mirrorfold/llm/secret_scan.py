"""Secret scan: fixed patterns, and a linear-chain conditional random field.

Base spans come from three fixed patterns and always stay. The field tags the
tokens of the whole text as secret begin, inside or outside. Its emissions add
up weights for the shape of the token, the shapes and the words beside it, and
figures of the whole file; its transitions are weights for label pairs. The
best labels are found by Viterbi. Spans that the field adds have the kind
``field`` and never overlap a base span.

Decoding is exact without running Viterbi over every token: a stretch of
begin or inside labels can only beat outside if its emissions' lead outweighs
its transitions, so with running sums and extremes all tokens are found, in
numpy, through which some such stretch could pass. All others are outside in
the best labelling, and only runs of the rest are decoded token by token.

The field learns from base spans: their tokens are begin and inside. It is
fitted on windows from at most ``TRAIN_DOCS`` documents, those with the
smallest id hash, and at most ``TRAIN_WINDOWS`` windows; both bounds are
parameters. Every document is scanned in full.

Null and empty texts have no spans. Without any base span to learn from, the
field tags nothing. Null ids, repeated rows and extra columns pass through.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from mirrorfold.llm.common import fresh, map_texts

TRAIN_DOCS = 8_000
TRAIN_WINDOWS = 4_000
REACH = 8  # tokens on each side in a training window
BUCKETS = 4096
ROUNDS = 80
REMEMBERED = 300_000
MASK = "[SECRET]"

# The base patterns, in the order in which equal starts are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "field"]

# Lower-case parts of the names in ASSIGN; a text without any of them has no match.
_NAMES = ("passw", "secret", "token", "api")

# A token is a run without ASCII white space, quotes, brackets and the marks that join a name to its value.
_APART = "\t\n\x0b\x0c\r \"'`:=,;()<>[]{}|"
_TOKEN = re.compile("[^" + re.escape(_APART) + "]+")
_SPACED = bytes(32 if chr(b) in _APART else b for b in range(256))
# Kinds of bytes: hexadecimal letters, other small letters, capitals, digits, other ASCII, the rest.
_KIND = bytes(b"a"[0] if 97 <= b <= 102 else b"g"[0] if 103 <= b <= 122 else b"A"[0] if 65 <= b <= 90 else
              b"0"[0] if 48 <= b <= 57 else b"."[0] if b < 128 else b"n"[0] for b in range(256))
_LENGTHS = (4, 8, 12, 16, 20, 28, 40)
OUT, BEGIN, INSIDE = 0, 1, 2


def _assignments(text: str) -> list[re.Match]:
    lower = text.lower()
    if not any(name in lower for name in _NAMES):
        return []
    return [m for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in order; kind is a place in ``KINDS``."""
    found = [(m.start(), 0, m.end()) for m in _assignments(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def secret_parts(text: str) -> list[tuple[int, int]]:
    """The secret itself within each base span, merged where they overlap."""
    parts = [m.span(2) for m in _assignments(text)]
    parts += [(s, e) for s, kind, e in base_spans(text) if kind]
    merged: list[tuple[int, int]] = []
    for s, e in sorted(parts):
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return merged


def _length(n: int) -> int:
    return sum(n >= bound for bound in _LENGTHS)


def shape(token: bytes) -> int:
    """Length, share of digits and kinds of characters, in one number below ``SHAPES``."""
    kinds, n = token.translate(_KIND), len(token)
    mask = sum(1 << k for k, kind in enumerate(b"agA.n") if kind in kinds)
    return (_length(n) * 5 + 4 * kinds.count(b"0") // n) * 32 + mask


SHAPES = 8 * 5 * 32


class Codes(dict):
    """From a token to its shape and the bucket of its word, in one number; remembers tokens."""

    def __missing__(self, token: bytes) -> int:
        code = shape(token) * BUCKETS + zlib.crc32(token.lower()[:60]) % BUCKETS
        if len(token) < 60:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = code
        return code


NOTHING = (SHAPES - 1) * BUCKETS


def token_codes(text: str, codes: Codes) -> np.ndarray:
    tokens = text.encode().translate(_SPACED).split()
    return np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens))


def file_code(text: str) -> int:
    """Figures of the whole file: signs of assignments, share of digits and of lines that are short."""
    n = max(len(text), 1)
    digits = sum(map(text.count, "0123456789"))
    return (min(text.count("=") + text.count(":"), 3) * 4 + min(40 * digits // n, 3)) * 4 + min(100 * text.count("\n") // n, 3)


FILE_CODES = 64
# Where each feature's rows begin in the table of weights: own shape, own length with digits, own kinds of
# characters, shape on the left and right, word on the left and right, file with own length and digits.
_STARTS = np.cumsum([0, SHAPES, SHAPES // 32, 32, SHAPES, SHAPES, BUCKETS, BUCKETS, FILE_CODES * (SHAPES // 32)]).tolist()
ROWS = _STARTS[-1]


def features(codes: np.ndarray, left: np.ndarray, right: np.ndarray, whole) -> list[np.ndarray]:
    """The row of each feature in the table of weights."""
    own, at = codes // BUCKETS, _STARTS
    return [own, at[1] + own // 32, at[2] + own % 32, at[3] + left // BUCKETS, at[4] + right // BUCKETS,
            at[5] + left % BUCKETS, at[6] + right % BUCKETS, at[7] + whole * (SHAPES // 32) + own // 32]


@dataclass
class Field:
    """``weights``: a row per feature, a column per label; ``moves[a, b]``: from label a to b."""

    weights: np.ndarray
    moves: np.ndarray

    def __post_init__(self):
        # Weights that depend on one shape alone, summed beforehand.
        w, at, shapes = self.weights, _STARTS, np.arange(SHAPES)
        self.own = w[:SHAPES] + w[at[1] + shapes // 32] + w[at[2] + shapes % 32]
        self.left, self.right = w[at[3]:at[4]], w[at[4]:at[5]]
        self.left_word, self.right_word = w[at[5]:at[6]], w[at[6]:at[7]]

    def emissions(self, codes: np.ndarray, whole: int) -> np.ndarray:
        padded = np.concatenate(([NOTHING], codes, [NOTHING]))
        shapes, words = padded // BUCKETS, padded % BUCKETS
        start = _STARTS[7] + whole * (SHAPES // 32)
        own = self.own + np.repeat(self.weights[start:start + SHAPES // 32], 32, axis=0)
        return (own[shapes[1:-1]] + self.left[shapes[:-2]] + self.right[shapes[2:]] + self.left_word[words[:-2]]
                + self.right_word[words[2:]])

    def labels(self, emissions: np.ndarray) -> np.ndarray:
        """The best labels; before the first and behind the last token is outside."""
        out, n = np.zeros(len(emissions), np.int8), len(emissions)
        if not n:
            return out
        moves = self.moves - self.moves[OUT, OUT]
        between = moves[1:, 1:].max()
        threshold = between - moves[OUT, 1:].max() - moves[1:, OUT].max()
        lead = emissions[:, 1:].max(axis=1) - emissions[:, OUT] + between
        sums = np.concatenate(([0.0], np.cumsum(lead)))
        through = (sums[1:] - np.minimum.accumulate(sums[:-1])) + (
            np.maximum.accumulate(sums[:0:-1])[::-1] - sums[:-1]) - lead
        open_ = np.flatnonzero(through >= threshold - 1e-6)
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(open_) else []:
            out[run] = self._viterbi(emissions[run])
        return out

    def _viterbi(self, emissions: np.ndarray) -> list[int]:
        moves, rows = self.moves.tolist(), emissions.tolist()
        best, back = [moves[OUT][y] + rows[0][y] for y in range(3)], []
        for row in rows[1:]:
            came = [max(range(3), key=lambda a, y=y: best[a] + moves[a][y]) for y in range(3)]
            best = [best[a] + moves[a][y] + row[y] for y, a in enumerate(came)]
            back.append(came)
        y = max(range(3), key=lambda a: best[a] + moves[a][OUT])
        path = [y]
        for came in reversed(back):
            y = came[y]
            path.append(y)
        return path[::-1]


def added_spans(text: str, field: Field, codes: Codes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    found = field.labels(field.emissions(token_codes(text, codes), file_code(text)))
    marked = np.flatnonzero(found)
    if not len(marked):
        return []
    places = [m.span() for m in _TOKEN.finditer(text)]
    spans: list[list[int]] = []
    before = -2
    for i in marked.tolist():
        if spans and found[i] == INSIDE and i == before + 1:
            spans[-1][1] = places[i][1]
        else:
            spans.append([*places[i]])
        before = i
    return [(s, 3, e) for s, e in spans if all(e <= b or s >= t for b, _, t in base)]


def training_windows(doc: str, codes: Codes) -> list[tuple[list[int], list[int], int]]:
    """Windows of tokens around secrets, and a few without any: codes with one
    more token on each side, labels, file code."""
    places = [m.span() for m in _TOKEN.finditer(doc)]
    labels, parts, k = [], secret_parts(doc), 0
    inside = None
    for s, e in places:
        while k < len(parts) and parts[k][1] <= s:
            k += 1
        hit = k < len(parts) and parts[k][0] < e
        labels.append(OUT if not hit else INSIDE if inside == k else BEGIN)
        inside = k if hit else None
    found = token_codes(doc, codes).tolist()
    size = 2 * REACH + 1
    padded = [NOTHING] * (size + 1) + found + [NOTHING] * (size + 1)
    tags = [OUT] * (size + 1) + labels + [OUT] * (size + 1)
    starts, last = [], -size
    for i in (i for i, y in enumerate(labels) if y):
        if i >= last + REACH:
            last = i
            starts.append(i - REACH)
    # Quiet windows: the start, and around the longest token and the one with most digits that are no secrets.
    quiet = [i for i, y in enumerate(labels) if not y]
    if quiet:
        shapes = [c // BUCKETS // 32 for c in found]
        starts += {0, max(quiet, key=shapes.__getitem__) - REACH, max(quiet, key=lambda i: (shapes[i] % 5, shapes[i])) - REACH}
    return [(padded[s + size:s + 2 * size + 2], tags[s + size + 1:s + 2 * size + 1], file_code(doc)) for s in starts]


def fit(codes: np.ndarray, labels: np.ndarray, whole: np.ndarray, rounds: int = ROUNDS) -> Field:
    """Maximises the penalised likelihood of the windows; ``codes`` has one more token on each side."""
    if not labels.size or not labels.any():
        weights = np.zeros((ROWS, 3))
        weights[:SHAPES, OUT] = 1.0
        return Field(weights, np.zeros((3, 3)))
    n, size = labels.shape
    rows = np.stack(features(codes[:, 1:-1], codes[:, :-2], codes[:, 2:], whole[:, None]), axis=2)
    used, where = np.unique(rows, return_inverse=True)
    where = where.reshape(rows.shape)
    theta = np.zeros(3 * len(used) + 9)
    theta[3 * len(used) + np.arange(9)] = np.array([[1, 0, -1], [0, -1, 0], [0, -1, 0]]).ravel()
    gold = np.zeros((n, size, 3))
    np.put_along_axis(gold, labels[:, :, None], 1, axis=2)
    gold_moves = np.zeros((3, 3))
    np.add.at(gold_moves, (labels[:, :-1], labels[:, 1:]), 1)
    first, second, penalty = np.zeros_like(theta), np.zeros_like(theta), 0.3
    for step in range(1, rounds + 1):
        weights, moves = theta[:-9].reshape(-1, 3), np.exp(theta[-9:].reshape(3, 3))
        emit = weights[where].sum(axis=2)
        emit = np.exp(emit - emit.max(axis=2, keepdims=True))
        # Forward and backward sums, scaled to 1 at each token.
        ahead, behind = emit.copy(), np.ones_like(emit)
        for t in range(size):
            if t:
                ahead[:, t] *= ahead[:, t - 1] @ moves
            ahead[:, t] /= ahead[:, t].sum(axis=1, keepdims=True)
        for t in range(size - 2, -1, -1):
            behind[:, t] = (emit[:, t + 1] * behind[:, t + 1]) @ moves.T
            behind[:, t] /= behind[:, t].sum(axis=1, keepdims=True)
        share = ahead * behind
        share /= share.sum(axis=2, keepdims=True)
        pairs = ahead[:, :-1, :, None] * moves * (emit[:, 1:] * behind[:, 1:])[:, :, None, :]
        pairs = (pairs / pairs.sum(axis=(2, 3), keepdims=True)).sum(axis=(0, 1))
        miss = (gold - share).reshape(-1, 3)
        grad = np.empty_like(theta)
        flat = where.reshape(-1, where.shape[2])
        for y in range(3):
            grad[y:-9:3] = sum(np.bincount(flat[:, f], miss[:, y], len(used)) for f in range(flat.shape[1]))
        grad[-9:] = (gold_moves - pairs).ravel()
        grad -= penalty * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad ** 2
        theta += 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    weights = np.zeros((ROWS, 3))
    weights[used] = theta[:-9].reshape(-1, 3)
    return Field(weights, theta[-9:].reshape(3, 3))


def train(docs: DataFrame, docs_bound: int = TRAIN_DOCS, windows_bound: int = TRAIN_WINDOWS) -> Field:
    """Fits the field on windows of documents of smallest id hash. *Action.*"""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # At most docs_bound rows of one number, so the broadcast has that bound.
    chosen = F.broadcast(docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(*order).limit(docs_bound))

    def run(batches):
        codes = Codes()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made = training_windows(text or "", codes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * len(made), pa.int64()), pa.array([any(m[1]) for m in made], pa.bool_()),
                     pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.int32())),
                     pa.array([m[2] for m in made], pa.int32())], names=["doc_id", "marked", "codes", "labels", "whole"])

    windows = docs.select("doc_id", "text").join(chosen, "doc_id").mapInArrow(
        run, "doc_id bigint, marked boolean, codes array<bigint>, labels array<int>, whole int")
    kept = windows.orderBy(F.desc("marked"), *order, "codes", "whole").limit(windows_bound).toPandas()
    if not len(kept):
        return fit(np.zeros((0, 3), np.int64), np.zeros((0, 1), np.int64), np.zeros(0, np.int64))
    return fit(np.array(kept["codes"].tolist()), np.array(kept["labels"].tolist(), np.int64), kept["whole"].to_numpy(np.int64))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                  T.StructField("end", T.IntegerType())]))
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(df: DataFrame, field: Field, spans: str = "spans", text: str = "text") -> DataFrame:
    """``df`` with all spans of ``text``, by start and then kind, in code points, end exclusive."""
    held = df.sparkSession.sparkContext.broadcast(field)

    def make():
        codes = Codes()

        def function(texts):
            out = []
            for t in texts:
                base = base_spans(t)
                found = sorted(base + added_spans(t, held.value, codes, base))
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found])
            return [pa.array(out, _SPANS_ARROW)]

        return function

    return map_texts(df, make, [T.StructField(spans, SPANS)], text)


def find_secrets(docs: DataFrame) -> DataFrame:
    """Counts, digest and listing of the spans of every document. *Action.*"""
    found = scan(docs.select("doc_id", "text"), train(docs)).drop("text")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], MASK]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by a mark, and ``n_chars`` counted anew where that changed a text. *Action.*"""
    clean = fresh(docs, "clean")
    held = docs.sparkSession.sparkContext.broadcast(train(docs))

    def make():
        codes = Codes()

        def function(texts):
            out = []
            for t in texts:
                base = base_spans(t)
                spans = sorted((s, e) for s, _, e in base + added_spans(t, held.value, codes, base))
                out.append(masked(t, spans) if spans else None)
            return [pa.array(out, pa.string())]

        return function

    done = map_texts(docs, make, [T.StructField(clean, T.StringType())])
    changed = F.col(clean).isNotNull()
    new = {"text": F.when(changed, F.col(clean)).otherwise(F.col("text")),
           "n_chars": F.when(changed, F.length(clean).cast("bigint")).otherwise(F.col("n_chars"))}
    return done.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])

