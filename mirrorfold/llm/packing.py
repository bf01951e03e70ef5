"""Best-fit packing: token pieces into sequences of bounded length.

``pack`` tokenizes every text, ends it with one id, cuts only what is longer
than a sequence, and places the pieces by bounded-space online best fit: a
fixed number of bins is open, a bitset has one bit per free space that some
open bin has, and a piece goes to the bin whose free space is the least that
holds it. Where none does and no more may open, the fullest bin closes first.
So a task holds ``open_bins`` sequences and nothing else, and the rows of one
sequence leave it together when its bin closes.

Every partition of the input is packed where it lies. Only the pieces of bins
still open at the end of a task are packed again, in groups of ``GROUP``
pieces by hash, level by level until one group is left; only their places
travel for that, not their ids. Bins are numbered by level, task and order.

White space parts the words of this vocabulary, which drops it, so the ids of a
text are those of its words one after the other; each Python worker remembers
the ids of ``REMEMBERED`` words at most, from task to task, and forgets those
longer unused first. Long texts are handled whole, one at a time.

Null and empty texts give the end id alone; an empty table gives no rows; rows
with equal or null ids are packed each for itself, with their own pieces.
Pieces of equal length take places in the order they come. Columns of the
input other than ``key`` and ``text`` are left out, so no name can clash.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from mirrorfold.llm.bpe import byte_letters
from mirrorfold.session import cut_lineage, scratch

CAPACITY = 4096
END_ID = 1
OPEN_BINS = 64
GROUP = 200_000
REMEMBERED = 400_000
WORD_BYTES = 200  # longer words are not remembered
FLUSH_BYTES = 4_000_000

# Letters that normalising only lowers, and closing marks that never join a letter's token. No mark that opens
# a special token (<) or a contraction (').
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&*]*)")

PIECE = [T.StructField(name, kind) for name, kind in (
    ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()),
    ("sequence_id", T.LongType()), ("offset", T.LongType()), ("_open", T.BooleanType()))]


class OpenBins:
    """Bounded-space best fit. ``place`` gives the bins that close, each a list of what it holds."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.spaces = 0  # bit f is set where an open bin has f free
        self.by_space: dict[int, list[list]] = {}
        self.count = 0

    def _take(self, space: int) -> list:
        bins = self.by_space[space]
        found = bins.pop()
        if not bins:
            del self.by_space[space]
            self.spaces ^= 1 << space
        self.count -= 1
        return found

    def place(self, length: int, item: tuple) -> Iterator[list]:
        fitting = self.spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            held = self._take(space)
        else:
            space, held = self.capacity, []
            if length < self.capacity and self.count == self.limit:
                yield self._take((self.spaces & -self.spaces).bit_length() - 1)
        held.append((self.capacity - space, *item))
        if space == length:
            yield held
            return
        self.by_space.setdefault(space - length, []).append(held)
        self.spaces |= 1 << (space - length)
        self.count += 1

    def rest(self) -> Iterator[list]:
        """The bins that are still open, fullest first."""
        while self.count:
            yield self._take((self.spaces & -self.spaces).bit_length() - 1)


class WordIds:
    """Little-endian 32-bit ids of whole texts, made of the ids of their words.

    A word of plain letters, with closing marks or without, goes to the
    library's merges at once; any other goes through its whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        self.letters = dict(enumerate(byte_letters()))
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # words of before, until as many new ones are known
        self.stems: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _whole(self, word: str) -> bytes:
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            text = word.decode()
            if len(word) > WORD_BYTES:
                return self._whole(text)
            plain = PLAIN.fullmatch(text)
            if plain is None:
                ids = self._whole(text)
            else:
                stem, marks = plain.groups()
                stem = stem.lower()
                ids = self.stems.get(stem)
                if ids is None:
                    parts = self.merge(stem.encode().decode("latin-1").translate(self.letters))
                    ids = struct.pack(f"<{len(parts)}I", *[p.id for p in parts])
                    if len(self.stems) >= REMEMBERED:
                        self.stems.clear()
                    self.stems[stem] = ids
                if marks:
                    closing = self.marks.get(marks)
                    if closing is None:
                        if len(self.marks) >= REMEMBERED:
                            self.marks.clear()
                        closing = self.marks[marks] = self._whole(marks)
                    ids += closing
        if 2 * len(self.words) >= REMEMBERED:
            self.older, self.words = self.words, {}
        self.words[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        known, learn = self.words.get, self._learn
        # ASCII white space parts words; the tokenizer sees to any other
        return b"".join([known(w) or learn(w) for w in text.encode().split()])


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """Those of this Python worker, so that its next task need not load and learn all again."""
    return WordIds(path)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, open_bins: int = OPEN_BINS, group: int = GROUP) -> DataFrame:
    """One row per piece: ``key``, piece, start, length, ids (little-endian 32-bit), sequence_id, offset. *Action.*"""
    spark = docs.sparkSession
    folder = scratch(spark, "packed")
    _first_level(docs.select(key, text), tokenizer, capacity, end_id, open_bins).write.parquet(folder)
    packed = spark.read.parquet(folder)
    columns = [c for c in packed.columns if c != "_open"]
    waiting = packed.filter("_open")
    places = _repacked(waiting.select("sequence_id", "offset", "length"), capacity, open_bins, group)
    moved = (waiting.join(places.withColumnsRenamed({"sequence_id": "_bin", "offset": "_at"}),
                          (F.col("sequence_id") == F.col("_bin")) & (F.col("offset") == F.col("_at")))
             .drop("sequence_id", "offset").withColumnsRenamed({"_sequence": "sequence_id", "_place": "offset"}))
    return packed.filter("not _open").select(columns).unionByName(moved.select(columns))


def _first_level(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, open_bins: int) -> DataFrame:
    key = docs.schema.fields[0]
    schema = T.StructType([T.StructField(key.name, key.dataType), *PIECE])
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        ids_of, bins, number = word_ids(tokenizer), OpenBins(capacity, open_bins), 0
        rows, size, arrow = [], 0, None

        def flush() -> pa.RecordBatch:
            cells = list(zip(*rows)) if rows else [()] * len(arrow)
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, arrow)], schema=arrow)
            rows.clear()
            return made

        def closed(held: list, is_open: bool) -> int:
            nonlocal number
            for place, doc, piece, start, ids in held:
                rows.append((doc, piece, start, len(ids) // 4, ids, task + number, place, is_open))
            number += 1
            return sum(len(item[4]) for item in held)

        for batch in batches:
            arrow = arrow or pa.schema([
                batch.schema.field(0), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("_open", pa.bool_())])
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(value.as_py() or "") + end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start:4 * (start + capacity)]
                    for held in bins.place(len(part) // 4, (doc, piece, start, part)):
                        size += closed(held, False)
                    if size > FLUSH_BYTES:
                        yield flush()
                        size = 0
        for held in bins.rest():
            closed(held, True)
        if rows:
            yield flush()

    return docs.mapInArrow(run, schema)


def _repacked(items: DataFrame, capacity: int, open_bins: int, group: int) -> DataFrame:
    """``sequence_id, offset`` (as they were), ``_sequence, _place`` for every item: levels of groups by hash."""
    done, level = None, 1
    while True:
        groups = max(1, -(-items.count() // group))
        order = F.xxhash64("sequence_id", "offset", F.lit(level))
        dealt = items.select("sequence_id", "offset", "length", F.pmod(order, F.lit(groups)).alias("_group"), order.alias("_order"))
        last, base = groups == 1, level << 56

        def run(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["_order", "sequence_id", "offset"])
            bins, first, out = OpenBins(capacity, open_bins), base + (int(keys[0]) << 32), []

            def close(held: list, is_open: bool) -> None:
                out.extend((*item[1:], first + close.number, item[0], is_open) for item in held)
                close.number += 1

            close.number = 0
            for sequence, offset, length in zip(part["sequence_id"].tolist(), part["offset"].tolist(), part["length"].tolist()):
                for held in bins.place(length, (sequence, offset, length)):
                    close(held, False)
            for held in bins.rest():
                close(held, not last)
            return pd.DataFrame(out, columns=["sequence_id", "offset", "length", "_sequence", "_place", "_open"])

        placed = cut_lineage(dealt.groupBy("_group").applyInPandas(
            run, "sequence_id long, offset long, length long, _sequence long, _place long, _open boolean"))
        settled = placed.filter("not _open").select("sequence_id", "offset", "_sequence", "_place")
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done
        items, level = placed.filter("_open"), level + 1
