"""Every stage over odd rows, and the whole pipeline against its parts in plain Python."""

import os

import pytest

import corpus_pipeline
from mirrorfold.llm import bpe, decontamination, quality_rules, secret_scan
from mirrorfold.llm.common import table
from mirrorfold.llm.queries import tokenizer_path
from tests.llm.cases import documents
from tests.llm.test_near_copies import plain_kept

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stage_survives_odd_rows(spark, number):
    _, stage = corpus_pipeline.STAGES[number]
    for docs in (documents(spark), documents(spark, extra=False).limit(0)):
        out = stage(spark, docs, FOLDER)
        out.collect()
        if number + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns


def test_run(spark):
    docs = table(spark, FOLDER, "documents")
    judged = {r["doc_id"] for r in quality_rules.judge(docs, table(spark, FOLDER, "labels")).filter("kept").collect()}
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] in judged}
    alone = plain_kept(rows)
    leaked = {r["doc_id"] for r in decontamination.leaks(docs, table(spark, FOLDER, "benchmark")).collect()}
    kept = {i: t for i, t in rows.items() if i in alone and i not in leaked}
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert found.keys() == kept.keys()
    encoder = bpe.Encoder(bpe.Vocabulary(tokenizer_path()))
    for i, text in kept.items():
        if not secret_scan.base_spans(text):
            assert found[i]["n_tokens"] == len(encoder.ids(text))
