"""Quality rules with risk-controlled cutoffs.

A fixed base check (too few words, too much repetition) is followed by rules
on four ratios. A rule rejects a text whose ratio is above the cutoff of the
text's stratum (language and length). Cutoffs are chosen from a fixed grid on
labelled holdout texts: a cutoff is *certified* if the exact binomial test
refutes, at level ``DELTA`` over the number of strata times rules, that it
rejects more than ``ALPHA`` over the number of rules of the good texts of the
stratum (this is the same as a Clopper-Pearson upper bound below that share).
Cutoffs are tested from the loosest inwards up to the first that fails, which
needs no further correction, so with probability ``1 - DELTA`` no stratum
loses more than ``ALPHA`` of its good texts. Among certified cutoffs the one
that rejects most bad texts, a good one weighing ``GOOD_WEIGHT`` bad ones, is
used; ties go to the loosest. Where nothing is certified the rule rejects
nothing.

Null and empty texts have no words and fail the base check. Documents without
a usable label take part in no count but get a verdict; conflicting labels
count by majority, ties as good. Null languages belong to the stratum "other".
Null ids, repeated rows and extra columns pass through.
"""

from __future__ import annotations

from math import exp, inf, lgamma, log, log1p

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from mirrorfold.llm.common import fresh, map_texts
from mirrorfold.session import cut_lineage

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
ALPHA = 0.05
DELTA = 0.05
GOOD_WEIGHT = 20
LANGUAGES = ("de", "en", "es", "fr")
LENGTHS = (100, 1000)

# Per thousand words; the loosest cutoff comes last.
GRID = [0, 1, 2, 5, 10, 20, 35, 50, 75, 100, 150, 200, 300, 400, 600, 800, 1000, 1500, 2000, 3000, 5000, 8000, 12000, 20000]
SYMBOLS = [b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = {
    "symbols": lambda: F.col("n_symbols"),
    "repeated_lines": lambda: F.col("n_dup_lines"),
    "repeated_words": lambda: F.col("n_repeat_words"),
    "word_length": lambda: F.col("word_chars"),
}


def counts(text: str) -> tuple[int, int, int, int, int]:
    """The five counts of one text."""
    data = text.encode()
    words = data.split()
    n = len(words)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeated = 0
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) < len(windows):
        times: dict[tuple, int] = {}
        for w in windows:
            times[w] = times.get(w, 0) + 1
        end = 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + WINDOW - max(end, i)
                end = i + WINDOW
    spaces = sum(map(data.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")))
    symbols = sum(data.count(s) for s in SYMBOLS)
    return n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    def make():
        return lambda texts: [pa.array(x, pa.int64()) for x in zip(*map(counts, texts))]

    return map_texts(df, make, [T.StructField(c, T.LongType()) for c in COUNTS], text)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def stratum(lang: str = "lang") -> Column:
    """A number below ``strata()``; its parts are fixed lists, so their number is."""
    language = F.lit(len(LANGUAGES))
    for i, name in enumerate(LANGUAGES):
        language = F.when(F.col(lang) == name, i).otherwise(language)
    length = F.lit(0)
    for bound in LENGTHS:
        length = length + (F.col("n_words") >= bound).cast("int")
    return language * (len(LENGTHS) + 1) + length


def strata() -> int:
    return (len(LANGUAGES) + 1) * (len(LENGTHS) + 1)


def ratio(rule: str) -> Column:
    return F.floor(1000 * RULES[rule]() / F.greatest(F.col("n_words"), F.lit(1)))


def _bin(value: Column) -> Column:
    """How many cutoffs of the grid lie below: the cutoffs that reject the value."""
    return sum((value > c).cast("int") for c in GRID)


def lower_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n trials at p."""
    if n == 0:
        return 1.0
    if k >= n:
        return 1.0
    top = lgamma(n + 1)
    return min(1.0, sum(exp(top - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(k + 1)))


def choose(good: list[int], bad: list[int]) -> float:
    """The cutoff for one stratum and rule; ``good[i]`` texts are rejected by the
    first ``i`` cutoffs of the grid and no others."""
    n, risk, level = sum(good), ALPHA / len(RULES), DELTA / (strata() * len(RULES))
    best, cutoff = 0, inf
    lost = caught = 0
    for i in range(len(GRID) - 1, -1, -1):
        lost, caught = lost + good[i + 1], caught + bad[i + 1]
        if lower_tail(lost, n, risk) > level:
            break
        if caught - GOOD_WEIGHT * lost > best:
            best, cutoff = caught - GOOD_WEIGHT * lost, GRID[i]
    return cutoff


def calibrate(counted: DataFrame, labels: DataFrame) -> dict[tuple[int, str], float]:
    """Cutoffs by stratum and rule, from the labelled rows of ``counted``. The
    driver sees one histogram of fixed size. *Action.*"""
    voted = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).alias("good"))
    held = counted.filter(~base_failed()).join(voted, "doc_id").select(
        stratum().alias("stratum"), "good",
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), _bin(ratio(r)).alias("bin")) for r in RULES])).alias("x"))
    seen = {(r["stratum"], r["rule"], r["good"], r["bin"]): r["n"] for r in held.groupBy(
        "stratum", "good", "x.rule", "x.bin").agg(F.count("*").alias("n")).collect()}
    bins = range(len(GRID) + 1)
    return {(s, r): choose(*[[seen.get((s, r, g, b), 0) for b in bins] for g in (True, False)])
            for s in range(strata()) for r in RULES}


def rejected_by(cutoffs: dict[tuple[int, str], float]) -> Column:
    """The rules that reject a row, as an array of names."""
    hits = []
    for rule in RULES:
        limits = F.array(*[F.lit(float(cutoffs[s, rule])) for s in range(strata())])
        hits.append(F.when(ratio(rule) > limits[stratum()], F.lit(rule)))
    return F.array_compact(F.array(*hits))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict of every document. *Action.*"""
    counted = cut_lineage(with_counts(docs.select("doc_id", "lang", "text")).drop("text"))
    rules = rejected_by(calibrate(counted, labels))
    return counted.select("doc_id", *COUNTS, base_failed().alias("base_failed"),
                          (~base_failed() & (F.size(rules) == 0)).alias("kept"), rules.alias("rejected_by"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, columns unchanged. *Action.*"""
    counted = with_counts(docs.select("doc_id", "lang", "text")).drop("text")
    cutoffs = calibrate(counted, labels)
    # Columns of docs that are named like a count step aside while the counts are there.
    aside = {c: fresh(docs, f"own_{c}") for c in docs.columns if c.lower() in COUNTS}
    kept = with_counts(docs.withColumnsRenamed(aside)).filter(~base_failed() & (F.size(rejected_by(cutoffs)) == 0))
    return kept.drop(*COUNTS).withColumnsRenamed({new: old for old, new in aside.items()})
