"""BPE against the tokenizers library."""

import hashlib

import pytest

from mirrorfold.llm import bpe
from mirrorfold.llm.queries import tokenizer_path
from tests.llm.cases import TEXTS, documents

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(tokenizer_path()))


def test_every_code_point(library, encoder):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["a" + "".join(f"{c}b {c}{c} 1" for c in points[i:i + 16]) for i in range(0, len(points), 16)]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert encoder.ids(text).tolist() == found.ids


def test_long_words_and_special_tokens(library, encoder):
    texts = ["ab" * 3000, "the" * 900 + "!" * 2000, " " * 1000 + "x", "a<|endoftext|><|endoftext|> b", "\n\n \n x\t\ty ", "é" * 700]
    for text in texts:
        assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    vocabulary = encoder.vocabulary
    for word in (b"therefore", b"xyzzyxyzzy", "żółć".encode() * 20):
        assert vocabulary.merge_by_scan(word) == vocabulary.merge_by_heap(word)


def test_rows(spark, library):
    rows = bpe.round_trip_digests(documents(spark), tokenizer_path()).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r["doc_id"] is not None:
            text = TEXTS[r["doc_id"]] or ""
            ids = library.encode(text, add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            back = library.decode(ids, skip_special_tokens=False)
            assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.round_trip_digests(documents(spark).limit(0), tokenizer_path()).count() == 0


def test_decode_of_any_ids(spark, library):
    lists = [[0, 255, 50256], [], [128, 200], None, [50255, 11, 223]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "k int, ids array<int>")
    for r in bpe.decode(df, tokenizer_path()).collect():
        assert r["decoded"] == library.decode(lists[r["k"]] or [], skip_special_tokens=False)


def test_round_trip_has_one_worker(spark, capsys):
    """Encoding and decoding share a Python worker, and what it gives is what both give apart."""
    docs = documents(spark).select("doc_id", "text")
    path = tokenizer_path()
    both = bpe.round_trip(docs, path)
    both.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    apart = bpe.decode(bpe.encode(docs, path).drop("text"), path)
    assert both.columns == apart.columns
    assert sorted(both.collect(), key=str) == sorted(apart.collect(), key=str)
