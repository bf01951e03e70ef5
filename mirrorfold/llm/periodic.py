"""Periodic runs of words, found by string synchronising sets.

A run is a maximal stretch of at least ``max(least, 2 * period)`` words in
which words one smallest period apart are equal. ``periodic_runs`` finds every
run of every whole text. The texts of a chunk are looked at as one sequence of
word numbers, parted by numbers that occur once, so no run crosses texts.

* Periods below ``DIRECT`` are highly periodic regions; comparing the sequence
  with itself moved by the period shows them.
* For periods from ``3t`` to ``6t``, ``t`` a power of two, a synchronising set
  is built: a position is in it if the least hash of the ``t``-word windows
  from there on, ``t + 1`` of them, is the first or the last; windows of period
  at most ``t / 3`` have no hash. Whether a position is in the set depends on
  the ``2t`` words behind it alone, so both repeats in a run hold it, and pairs
  of equal contexts at such a distance propose the period.
* A text whose whole period is itself highly periodic has no position in the
  set. It lies across the border of two regions of one small period; the
  distances that put the phase of one region over the other are the periods
  left out, and are proposed too.

Each proposal is stretched both ways by binary search on prefix hashes, and a
run counts only after its words were compared. A stretch found under several
periods keeps the least. Work is a small multiple of ``n log n`` words for a
text of ``n`` words; a text of any length is handled whole in its task.

Null, empty and short texts have no runs and an empty or the same list of
words. Rows, ties, null keys and extra columns pass through unchanged; the two
added columns take longer names where theirs are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from mirrorfold.llm.common import fresh

LEAST = 12
DIRECT = 12  # three times the smallest scale
CHUNK_WORDS = 60_000

RUNS = T.ArrayType(T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")]))
ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)
FAR = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(MIX[0])
    x ^= x >> np.uint64(32)
    x *= np.uint64(MIX[2])
    return x ^ (x >> np.uint64(29))


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and end of every stretch of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).view(np.int8)))
    return edges[::2], edges[1::2]


class Prefixes:
    """Equality of two stretches of one sequence, by prefix hashes of 62 bits together."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words, self.power, self.prefix = words, [], []
        for p, b in zip(PRIMES, BASES):
            power, step = np.ones(max(n, 1), np.int64), 1
            while step < n:
                power[step:2 * step] = power[:min(step, n - step)] * pow(b, step, p) % p
                step *= 2
            # words are numbered from 1, and spread so that sums of near numbers do not cancel
            spread = (_mixed(words.astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % p
            prefix = np.zeros(n + 1, np.int64)
            np.cumsum(spread * power[:n] % p, out=prefix[1:])
            self.power.append(power)
            self.prefix.append(prefix % p)

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the words from ``a`` are those from ``b`` (``a <= b``), elementwise."""
        same = np.ones(len(a), bool)
        for p, power, prefix in zip(PRIMES, self.power, self.prefix):
            left = (prefix[a + length] - prefix[a]) % p * power[b - a] % p
            same &= left == (prefix[b + length] - prefix[b]) % p
        return same

    def _longest(self, most: np.ndarray, fits) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = fits(middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low

    def stretch(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The widest ``[start, end)`` round ``at`` in which words a period apart are equal."""
        ahead = self._longest(len(self.words) - at - period, lambda k: self.equal(at, at + period, k))
        behind = self._longest(at, lambda k: self.equal(at - k, at - k + period, k))
        return at - behind, at + ahead + period


def _windows_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, by running minima inside blocks of that width."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, FAR)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def _direct(words: np.ndarray, period: int) -> np.ndarray:
    if len(words) <= period:
        return np.zeros((0, 3), np.int64)
    start, end = _stretches(words[period:] == words[:-period])
    keep = end - start >= period
    start, end = start[keep], end[keep] + period
    return np.stack([start, end, np.full(len(start), period)], axis=1)


def _proposals(window: np.ndarray, context: np.ndarray, found: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of equal contexts in the synchronising set of scale ``t``."""
    size = len(window)
    value = window.copy()
    steep = found[(found[:, 2] <= t // 3) & (found[:, 1] - found[:, 0] >= t)]
    if len(steep):
        marks = np.zeros(size + 1, np.int32)
        np.add.at(marks, steep[:, 0], 1)
        np.add.at(marks, steep[:, 1] - t + 1, -1)
        value[np.cumsum(marks[:size]) > 0] = FAR
    least = _windows_min(value, t + 1)
    chosen = np.flatnonzero((least != FAR) & ((least == value[:-t]) | (least == value[t:])))
    chosen = chosen[chosen < len(context)]
    kept = context[chosen]
    order = np.argsort(kept, kind="stable")
    places, kept = chosen[order], kept[order]
    at, period, step = [], [], 1
    while step < len(places):
        apart = places[step:] - places[:-step]
        near = (kept[step:] == kept[:-step]) & (apart < 6 * t)
        if not near.any():
            break
        near &= apart >= 3 * t
        at.append(places[:-step][near])
        period.append(apart[near])
        step += 1
    return (np.concatenate(at), np.concatenate(period)) if at else (places[:0], places[:0])


def _across_borders(prefixes: Prefixes, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances that put one highly periodic region over the next one of its period, in phase."""
    steep = found[found[:, 1] - found[:, 0] >= 9 * found[:, 2]]
    steep = steep[np.lexsort((steep[:, 0], steep[:, 2]))]
    pairs = np.flatnonzero((steep[1:, 2] == steep[:-1, 2]) & (steep[1:, 0] <= steep[:-1, 1]))
    at, period = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in pairs:
        (a, a_end, p), (b, b_end, _) = steep[i], steep[i + 1]
        turns = np.arange(b, b + p)
        phase = turns[prefixes.equal(np.full(p, a), turns, np.full(p, p))]
        if len(phase):
            first = 9 * p + (phase[0] - a - 9 * p) % p
            distances = np.arange(first, min(a_end - a, b_end - b) + 1, p)
            at.append(np.maximum(a, b - distances))
            period.append(distances)
    return np.concatenate(at), np.concatenate(period)


def _checked(words: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Runs whose words are as the hashes said; where not, all stretches of that period, word by word."""
    wrong = [not np.array_equal(words[a:b - q], words[a + q:b]) for a, b, q in runs.tolist()]
    periods = {int(q) for q in runs[wrong, 2]} if any(wrong) else set()
    return np.concatenate([runs[~np.array(wrong, bool)], *[_direct(words, q) for q in sorted(periods)]])


def _least_periods(runs: np.ndarray) -> np.ndarray:
    """One row per stretch, by start and end, with its least period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def find_runs(words: np.ndarray, bounds: list[tuple[int, int]], least: int = LEAST) -> np.ndarray:
    """Rows ``start, end, period`` of all runs of a sequence of numbers from 1 on.

    ``bounds`` are its texts; between two of them stands a number that occurs once.
    """
    found = np.concatenate([_direct(words, q) for q in range(1, DIRECT)])
    found = _least_periods(found)
    longest = max((b - a for a, b in bounds), default=0)
    hashes = _mixed(words.astype(np.uint64))
    proposed, width, live = [], 1, bounds
    prefixes = None
    while 3 * width * 2 <= longest:
        if width >= 4 and 3 * width >= DIRECT:
            live = [(a, b) for a, b in live if b - a >= 6 * width]
            at, period = _of_live(hashes, live, found, width)
            if len(at):
                prefixes = prefixes or Prefixes(words)
                start, end = prefixes.stretch(at, period)
                runs = np.unique(np.stack([start, end, period], axis=1), axis=0)
                found = _least_periods(np.concatenate([found, runs[runs[:, 1] - runs[:, 0] >= 2 * runs[:, 2]]]))
        # the hash of a window of twice the width at every position that has one
        hashes = _mixed(hashes[:-width] * np.uint64(MIX[1]) + hashes[width:])
        width *= 2
    steep = found[found[:, 1] - found[:, 0] >= 9 * found[:, 2]]
    if len(steep) > 1:
        prefixes = prefixes or Prefixes(words)
        at, period = _across_borders(prefixes, found)
        if len(at):
            start, end = prefixes.stretch(at, period)
            runs = np.stack([start, end, period], axis=1)
            found = _least_periods(np.concatenate([found, runs[end - start >= 2 * period]]))
    found = _checked(words, found[found[:, 1] - found[:, 0] >= least])
    return _least_periods(found[found[:, 1] - found[:, 0] >= least])


def _of_live(hashes: np.ndarray, live: list[tuple[int, int]], found: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Proposals inside the texts of at least ``6t`` words; neighbours of them are looked at together."""
    at, period = [], []
    for a, b in _joined(live):
        part = found[(found[:, 0] >= a) & (found[:, 1] <= b)] - np.array([a, a, 0])
        window = hashes[a:b - t + 1]
        context = _mixed(window[:-t] * np.uint64(MIX[1]) + window[t:])
        x, q = _proposals(window, context, part, t)
        at.append(x + a)
        period.append(q)
    return (np.concatenate(at), np.concatenate(period)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _joined(bounds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in bounds:
        if out and out[-1][1] + 1 == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def runs_of_texts(texts: list[bytes], least: int = LEAST) -> list[tuple[list[bytes], np.ndarray]]:
    """Words and runs (rows ``start, length, period`` by start, then period) of every text."""
    split = [t.split() for t in texts]  # ASCII white space alone
    number: dict[bytes, int] = {}
    ids, bounds = [], []
    for words in split:
        first = len(ids)
        ids.extend([number.setdefault(w, len(number) + 1) for w in words])
        bounds.append((first, len(ids)))
        ids.append(0)
    sequence = np.array(ids, np.int64)
    ends = np.array([b for _, b in bounds], np.int64)
    sequence[ends] = len(number) + 1 + np.arange(len(ends))
    found = find_runs(sequence, [x for x in bounds if x[1] - x[0] >= least], least)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    cut = np.searchsorted(found[:, 0], [a for a, _ in bounds] + [len(ids)])
    return [(words, np.stack([f[:, 0] - a, f[:, 1] - f[:, 0], f[:, 2]], axis=1))
            for words, (a, _), f in zip(split, bounds, (found[cut[i]:cut[i + 1]] for i in range(len(split))))]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(marks[:-1]) == 0
    return b" ".join([w for w, k in zip(words, kept.tolist()) if k])


def periodic_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed",
                  least: int = LEAST) -> DataFrame:
    """All rows and columns, the runs of each text, and the text without what its runs repeat.

    ``runs`` lists word number, words and period, by start and then period.
    """
    runs, collapsed = fresh(docs, runs), fresh(docs, collapsed)
    schema = T.StructType([*docs.schema.fields, T.StructField(runs, RUNS), T.StructField(collapsed, T.StringType())])
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x.as_py() or "").encode() for x in batch.column(place)]
            first = 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size + len(texts[last]) <= 6 * CHUNK_WORDS):
                    size += len(texts[last])
                    last += 1
                found = runs_of_texts(texts[first:last], least)
                columns = [
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in f.tolist()] for _, f in found], ARROW_RUNS),
                    pa.array([collapse(w, f).decode() for w, f in found], pa.string())]
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, runs, collapsed])
                first = last

    return docs.mapInArrow(run, schema)
