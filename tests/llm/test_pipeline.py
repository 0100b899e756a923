from __future__ import annotations

import corpus_pipeline
from tests.llm import test_minhash, test_repeats
from tests.llm.data import documents, empty

import __spark_entry__ as entry
from trendloom.llm import minhash, queries, repeats
from trendloom.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def test_every_query_is_registered(spark):
    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


def test_stages_one_by_one(spark):
    docs = table(spark, FOLDER, "documents")
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, FOLDER, "labels").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near-copies", "repeats", "personal-data", "packing"]

    clean = corpus_pipeline.drop_toxic(spark, docs, FOLDER)
    assert clean.schema == docs.schema
    gone = given.keys() - {r["doc_id"] for r in clean.collect()}
    assert all(labels.get(i) != 0 for i in gone)

    few = corpus_pipeline.drop_near_copies(spark, clean, FOLDER)
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    want = sorted(r[0] for r in test_minhash.brute(rows, 5) if r[3])
    assert sorted(r["doc_id"] for r in few.collect()) == want and few.schema == docs.schema

    short = corpus_pipeline.drop_repeats(spark, few, FOLDER)
    rows = sorted((r["doc_id"], r["text"]) for r in few.collect())
    marks = test_repeats.covered([t.encode() for _, t in rows], repeats.Rule().length)
    got = {r["doc_id"]: r["text"].encode() for r in short.collect()}
    for (i, text), mark in zip(rows, marks):
        left = bytes(b for b, c in zip(text.encode(), mark) if not c)
        assert 0 <= len(got[i]) - len(left) <= 6 * text.count("é") + 6 * len(text)
        if text.isascii():
            assert got[i] == left

    redacted = corpus_pipeline.redact(spark, short, FOLDER)
    assert redacted.schema == docs.schema and redacted.count() == short.count()
    assert not redacted.where(r"text rlike '[A-Za-z0-9]@[a-z0-9]+[.][a-z]'").count()

    pieces = corpus_pipeline.pack(spark, redacted, FOLDER)
    assert pieces.select("doc_id").distinct().count() == short.count()


def test_awkward_rows_pass_every_stage(spark):
    for docs in (documents(spark), empty(spark)):
        rows = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            if name != "packing":
                assert out.columns == docs.columns
                docs = out
            assert (out.count() > 0) == (rows > 0)


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 0 and "tokens" in out.columns


def test_rule_of_near_copies():
    assert corpus_pipeline.NEAR == minhash.Rule(words=5, percent=80)
