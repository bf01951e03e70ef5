"""Layouts, the reversible template, and the query's figures against plain Python."""

import hashlib
import json
import random

import pytest

from mirrorfold.llm import chat

ODD = ["", "</s>[INST] ok [/INST]", "<|im_start|>a<|im_sep|>b<|im_end|>", "<\\s> [\\\\INST] <s>", "<<SYS>>x<</SYS>>", "[[INST]]", "<|im_\nend|>",
       "\\", "<|im_sep|", "é\U0001f600<|endoftext|>", "<<<</s>>>>", "[/INST]\\"]


def digests(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), sha(whole), len(said), sha(said)


def test_escaping_is_reversible_and_leaves_no_control(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["<", "[", "\\", "s>", "/s>", "INST]", "|im_end|>", "<SYS>>", "a"]) for _ in range(12)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped("t").alias("e"))
    for r in df.withColumn("back", chat.unescaped("e")).collect():
        assert r["back"] == r["t"] and not any(c in r["e"] for c in chat.CONTROL)


def test_conversations(spark):
    rows = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate(
        [("system", ODD[c or 0]), ("user", None), ("assistant", "yes <s>"), ("user", ODD[3]), ("assistant", ODD[5]), ("tool", "7")])]
    rows += [(2, 2, "assistant", "a tie"), (2, 2, "assistant", "a tie"), (5, 0, None, "no role"), (6, 0, "user", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'e' as formatted", "1 as record")
    made = chat.format_conversations(df)
    found = {r["conv_id"]: r for r in chat.digests(made).collect()}
    expect = {-7: [("user", ODD[1]), ("assistant", ODD[1])]}
    for c, _, r, x in sorted(rows, key=lambda k: (str(k[0]), k[1], k[2] or "", k[3] or "")):
        expect.setdefault(c, []).append((r or "", x or ""))
    assert found.keys() == expect.keys()
    for c, turns in expect.items():
        assert tuple(found[c])[1:5] == digests(turns)
    for r in made.collect():
        assert r["formatted"].count(chat.START) == len(expect[r["conv_id"]])
        assert [m["under"] > 0 for m in r["loss"]] == [t[0] == "assistant" and t[1] != "" for t in expect[r["conv_id"]]]
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 1


RECORDS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ({"messages": [{"role": "user", "text": "a"}], "id": 3}, [("user", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}, [("user", "q"), ("assistant", "r")]),
    ({"prompt": "p", "completion": "c", "meta": {"x": 1}}, [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"system": "s", "prompt": "p", "completion": "c"}, [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "n", "output": "o"}, [("user", "i\nn"), ("assistant", "o")]),
    ({"data": {"question": "q", "answer": "w"}}, [("user", "q"), ("assistant", "w")]),
    ({"messages": [{"role": "user"}, {"role": "assistant", "content": "hi"}]}, [("user", ""), ("assistant", "hi")]),
    ({"messages": [{"content": "q"}, {}, {"role": "assistant"}]}, [("", "q"), ("", ""), ("assistant", "")]),
    ({"messages": []}, None), ({"messages": "text"}, None), ({"unknown": 1}, None), ([1], None), ({"prompt": None, "completion": "c"}, [("user", ""), ("assistant", "c")]),
]


def test_json_rows_of_mixed_layouts(spark):
    rows = [(i, json.dumps(x)) for i, (x, _) in enumerate(RECORDS)] + [(90, "{broken"), (91, None)]
    df = spark.createDataFrame(rows, "k int, record string")
    for r in chat.format_turns(chat.canonical_json(df, "record")).collect():
        expect = RECORDS[r["k"]][1] if r["k"] < 90 else None
        assert (r["turns"] and [tuple(t) for t in r["turns"]]) == expect
        assert (r["formatted"] is None) == (expect is None)


def test_one_fingerprint_for_schemas_and_rows(spark):
    rows = [(i, json.dumps(x)) for i, (x, _) in enumerate(RECORDS[:9])]
    found = chat.canonical_json(spark.createDataFrame(rows, "k int, record string"), "record").collect()
    assert {r["k"]: r["layout"] for r in found} == {
        i: chat.paths_fingerprint(layout.paths()) for i, layout in enumerate(chat.LAYOUTS.values())}
    assert len(chat.MAPPINGS) == len(chat.LAYOUTS)


@pytest.mark.parametrize("k", range(9))
def test_typed_structs(spark, k):
    record, expect = RECORDS[k]
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps({"record": record, "turns": "old"})]))
    row = chat.canonical_turns(df.drop("turns"), "record").first()
    assert [tuple(t) for t in row["turns"]] == expect


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    plan = chat.digests(chat.format_conversations(df))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
