"""Packing: the library's ids of whole texts, nothing lost, sequences nearly full."""

import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from mirrorfold.llm import packing
from mirrorfold.llm.queries import tokenizer_path
from tests.llm.cases import TEXTS, documents

PATH = tokenizer_path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def whole(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_of_every_letter_and_odd_words():
    odd = [f"{chr(c)}aé{chr(c)}, b{chr(c)}." for c in (*range(0x3000), *range(0xF900, 0x10000), *range(0x1F600, 0x1F700))]
    odd += [t or "" for t in TEXTS] + ["<|endoftext|>x", "don't I'LL 's", "á ́", "a<|startoftext|>.", "x.#", "ΣΑΣ ΑΣ.", "w" * 900]
    ids = packing.WordIds(PATH)
    for text, found in zip(odd, LIBRARY.encode_batch(odd, add_special_tokens=False)):
        assert np.frombuffer(ids(text), "<u4").tolist() == found.ids, text


def test_forgetting_words_changes_no_ids(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    ids = packing.WordIds(PATH)
    text = "one two, three. four 5 six! one seven? eight"
    assert [np.frombuffer(ids(text), "<u4").tolist() + [1] for _ in range(3)] == [whole(text)] * 3


def test_marks_behind_a_word_are_learned_once(monkeypatch):
    """Words that differ in their letters only do not each go through the whole tokenizer."""
    ids = packing.WordIds(PATH)
    asked, whole_ids = [], ids._whole
    monkeypatch.setattr(ids, "_whole", lambda word: asked.append(word) or whole_ids(word))
    marks = [a + b for a in ".,;:!?#$%&*" for b in ("", "###", ".$$$", "&*", "!?,")]
    text = " ".join(f"{stem}{m}" for m in marks for stem in ("Straße", "über", "word", "É"))
    assert np.frombuffer(ids(text), "<u4").tolist() + [1] == whole(text)
    assert asked == marks
    odd = "a<|endoftext|>. b's# c#'s d|. e<$ f$<|startoftext|>"
    assert np.frombuffer(ids(odd), "<u4").tolist() + [1] == whole(odd)


def test_words_in_use_are_not_forgotten(monkeypatch):
    """A word that comes again and again is made of merges once, however many others pass."""
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    ids = packing.WordIds(PATH)
    made, merge = [], ids.merge
    monkeypatch.setattr(ids, "merge", lambda word: made.append(word) or merge(word))
    stems = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    for stem in stems:
        assert np.frombuffer(ids(f"again {stem}"), "<u4").tolist() + [1] == whole(f"again {stem}")
    assert len(made) == len(stems) + 1 and len(ids.words) + len(ids.older) <= 20
    assert packing.word_ids(PATH) is packing.word_ids(PATH)


def test_best_fit_against_a_plain_scan():
    """The least space that holds the piece; the fullest bin closes when no more may open."""
    rng = random.Random(4)
    for limit in (1, 3, 8):
        bins, plain, closed = packing.OpenBins(50, limit), [], []
        expected = []
        for n in range(400):
            length = rng.randrange(1, 51)
            closed += [[item[1] for item in held] for held in bins.place(length, (n,))]
            fits = [b for b in plain if b[0] >= length]
            if fits:
                best = min(b[0] for b in fits)
                home = [b for b in fits if b[0] == best][-1]
                plain.remove(home)
            else:
                if length < 50 and len(plain) == limit:
                    least = min(b[0] for b in plain)
                    full = [b for b in plain if b[0] == least][-1]
                    plain.remove(full)
                    expected.append(full[1])
                home = [50, []]
            home = [home[0] - length, [*home[1], n]]
            (expected.append(home[1]) if home[0] == 0 else plain.append(home))
        assert closed == expected
        assert sorted(n for b in [*closed, *[[i[1] for i in h] for h in bins.rest()]] for n in b) == list(range(400))


def check(rows, texts, capacity):
    """Every piece of every text once, sequences without a gap and within ``capacity``. Number of sequences and ids."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == texts.keys()
    total = 0
    for key, held in pieces.items():
        for text in texts[key]:
            ids = whole(text)
            total += len(ids)
            for n, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start:start + capacity]
                data = np.asarray(part, "<u4").tobytes()
                found = next(r for r in held if (r["piece"], r["start"], r["length"], bytes(r["ids"])) == (n, start, len(part), data))
                held.remove(found)
        assert not held
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), total


def test_levels_of_many_tasks(spark):
    rng = random.Random(5)
    texts = {i: [" ".join(rng.choice(["red", "green", "blue,", "x9"]) for _ in range(int(rng.lognormvariate(2.5, 1))))] for i in range(1500)}
    texts[1500] = ["long " * 700]
    df = spark.createDataFrame([(i, t[0]) for i, t in texts.items()], "doc_id bigint, text string").repartition(12)
    rows = packing.pack(df, PATH, capacity=128, open_bins=16, group=150).collect()
    used, total = check(rows, texts, 128)
    assert used <= 1.03 * total / 128 + 1


def test_odd_rows(spark):
    df = documents(spark).withColumn("piece", df_extra()).withColumn("ids", df_extra())
    texts = defaultdict(list)
    for r in df.collect():
        texts[r["doc_id"]].append(r["text"])
    check(packing.pack(df, PATH).collect(), texts, packing.CAPACITY)
    empty = packing.pack(df.limit(0), PATH)
    assert empty.count() == 0 and "sequence_id" in empty.columns


def df_extra():
    from pyspark.sql import functions as F

    return F.lit("extra")


def test_query_columns(spark):
    from mirrorfold.llm.queries import QUERIES

    rows = QUERIES["op11_best_fit_packing"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        part = whole(texts[r["doc_id"]])[r["start"]:r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.asarray(part, "<u4").tobytes())
    assert sum(r["length"] for r in rows) == sum(len(whole(t)) for t in texts.values())
