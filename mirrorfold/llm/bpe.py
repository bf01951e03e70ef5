"""Byte-level BPE: encoding and decoding with a public vocabulary.

``encode`` gives the token ids of every text, ``decode`` the text of every
list of ids. A text is cut into chunks at white space, a chunk into words by
the pattern of the vocabulary, and each word is merged by a contiguous rank
array: the parts of the word and the ranks of adjacent parts lie side by side,
the smallest rank is found by scanning, its boundary is deleted and the two
ranks beside it are looked up again. Words longer than ``SCAN_BYTES`` take the
same merges from a heap, since scanning is quadratic. Chunks are remembered in
each task, at most ``REMEMBERED`` of them.

Null and empty texts give no ids; no ids give an empty text. Ids outside the
vocabulary are an error. Repeated rows, extra columns and null keys pass
through.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from mirrorfold.llm.common import fresh, map_texts

REMEMBERED = 300_000
SCAN_BYTES = 400

# The pattern of this family of vocabularies, and the white space it means by \s.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

NO_RANK = 1 << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable
    Latin-1 bytes stand for themselves, the others take the letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Vocabulary:
    """Token bytes, merge ranks and special tokens of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        ids = spec["model"]["vocab"]
        self.token_bytes = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes |= {i: content.encode() for content, i in self.special.items()}
        self.byte_ids = [ids[c] for c in letters]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank_of = {(ids[a] << 20) | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [ids[a + b] for a, b in pairs]

    def merge(self, word: bytes) -> list[int]:
        return self.merge_by_scan(word) if len(word) <= SCAN_BYTES else self.merge_by_heap(word)

    def merge_by_scan(self, word: bytes) -> list[int]:
        rank_of, merged = self.rank_of, self.merged
        parts = [self.byte_ids[b] for b in word]
        ranks = [rank_of.get((a << 20) | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            i = ranks.index(best)
            parts[i] = merged[best]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of.get((parts[i] << 20) | parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = rank_of.get((parts[i - 1] << 20) | parts[i], NO_RANK)
        return parts

    def merge_by_heap(self, word: bytes) -> list[int]:
        """The same merges, lowest rank and then leftmost first, in n log n."""
        rank_of, merged = self.rank_of, self.merged
        parts = [self.byte_ids[b] for b in word]
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            rank = rank_of.get((parts[i] << 20) | parts[j])
            if rank is not None:
                heapq.heappush(heap, (rank, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= len(parts) or parts[j] != right:
                continue
            parts[i], parts[j], after[i] = merged[rank], -1, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p >= 0]


class Words(dict):
    """From a word to its ids as the bytes of 32-bit numbers; remembers words."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self.vocabulary.merge(word.encode())).tobytes()
        if len(word) < 100:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class Encoder(dict):
    """From a chunk of text to its ids as bytes; remembers chunks."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        super().__init__()
        self.vocabulary = vocabulary
        self.words = regex.compile(WORDS).findall
        self.known = Words(vocabulary).__getitem__
        self.chunks = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]").findall
        self.cut = re.compile("(" + "|".join(map(re.escape, vocabulary.special)) + ")").split if vocabulary.special else None

    def __missing__(self, chunk: str) -> bytes:
        ids = b"".join(map(self.known, self.words(chunk)))
        if len(chunk) < 100:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> array:
        parts: list[bytes] = []
        for k, piece in enumerate(self.cut(text) if self.cut else (text,)):
            if k % 2:
                parts.append(array("i", [self.vocabulary.special[piece]]).tobytes())
            else:
                parts += map(self.__getitem__, self.chunks(piece))
        return array("i", b"".join(parts))


def _ids_column(lists: list[array]) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.frombuffer(b"".join(map(bytes, lists)), np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``text``. ``vocabulary`` is a tokenizer file
    of byte-level BPE at a path that every executor can open."""

    def make():
        encoder = Encoder(Vocabulary(vocabulary))
        return lambda texts: [_ids_column([encoder.ids(t) for t in texts])]

    return map_texts(df, make, [T.StructField(ids, T.ArrayType(T.IntegerType()))], text)


def _texts_column(lists: pa.Array, token) -> pa.Array:
    flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_pylist()
    texts, at = [], 0
    for n in offsets:
        texts.append(b"".join(map(token, flat[at:at + n].tolist())).decode(errors="replace"))
        at += n
    return pa.array(texts, pa.string())


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text that ``ids`` stand for; bytes that are no UTF-8 become U+FFFD."""
    schema, place = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]), df.columns.index(ids)

    def run(batches):
        token = Vocabulary(vocabulary).token_bytes.__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, _texts_column(part.column(place), token)],
                                                 names=[*part.schema.names, text])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Columns of ``df`` without the text, then the ids and the text decoded from them. Both are made
    in one Python worker, which holds the vocabulary once."""
    ids, decoded = fresh(df, "ids"), fresh(df, "decoded")

    def make():
        known = Vocabulary(vocabulary)
        encoder, token = Encoder(known), known.token_bytes.__getitem__

        def both(texts):
            found = _ids_column([encoder.ids(t) for t in texts])
            return [found, _texts_column(found, token)]

        return both

    return map_texts(df, make, [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())], text).drop(text)


def round_trip_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: token count and digests of ids and decoded text."""
    done = round_trip(docs.select("doc_id", "text"), vocabulary)
    return done.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
