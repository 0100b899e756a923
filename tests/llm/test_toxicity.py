from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from tests.llm.data import documents, empty

from trendloom.llm import common, toxicity
from trendloom.llm.common import utf8


def test_words_like_a_pattern(monkeypatch):
    rng = np.random.default_rng(1)
    for block in (5, 64, 1 << 20):
        monkeypatch.setattr(common, "BLOCK", block)
        texts = ["".join(rng.choice(list("abA é.\n"), rng.integers(0, 40))) for _ in range(30)]
        raw = [t.encode() for t in texts]
        at = np.cumsum([0, *map(len, raw)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        index, _, (whole, head) = common.words(data, at, toxicity.NO_LETTER, (2,))
        seen: dict[bytes, int] = {}
        for k, text in enumerate(raw):
            found = re.findall(rb"[A-Za-z\x80-\xff]+", text)
            assert index[k + 1] - index[k] == len(found)
            for word, h, short in zip(found, whole[index[k] : index[k + 1]], head[index[k] : index[k + 1]]):
                assert seen.setdefault(word.lower(), int(h)) == int(h)
                assert seen.setdefault(word.lower()[:2], int(short)) == int(short)
        assert len(set(seen.values())) == len(seen)


def tables(spark, n=600):
    """Insults are toxic only where a group is named too."""
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        text = [*rng.choice(["lorem", "ipsum", "dolor", "amet"], 20), *(["grobian"] if insult else []), *(["townsfolk"] if group else [])]
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(insult and group)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_pairs_of_terms_are_learned(spark):
    docs, labels = tables(spark)
    got = toxicity.predictions(docs, labels, toxicity.Limits(epochs=120)).join(labels, "doc_id").collect()
    kept = [r for r in got if r["held_out"]]
    assert len(kept) > 100
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["predicted"] == r["toxic"] for r in kept]) > 0.95


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, folder, "documents"), common.table(spark, folder, "labels")
    rows = toxicity.predictions(docs, labels).join(labels, "doc_id").where("held_out").collect()
    wrong = [r for r in rows if r["toxic"] == 0 and r["predicted"] == 1]
    found = [r for r in rows if r["toxic"] == 1 and r["predicted"] == 1]
    assert not wrong and len(found) >= 0.7 * sum(r["toxic"] for r in rows)


def test_held_out_labels_are_not_read(spark):
    docs, labels = tables(spark, 300)
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(labels["doc_id"]), 1 - labels["toxic"]).otherwise(labels["toxic"]))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert np.array_equal(a.slots, b.slots) and np.array_equal(a.weights, b.weights) and a.constant == b.constant


def test_awkward_rows(spark):
    docs, labels = tables(spark, 200)
    odd = documents(spark)
    rows = toxicity.score(odd, toxicity.fit(docs, labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    blank = {r["score"] for r in rows if r["doc_id"] in (3, 4, 5)}
    assert len(blank) == 1
    nothing = toxicity.fit(odd, labels.limit(0))
    assert {r["score"] for r in toxicity.score(odd, nothing).collect()} == {0.5}
    assert toxicity.score(empty(spark), nothing).count() == 0
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert not len(toxicity.fit(docs, none).slots)


def test_keep_clean_keeps_columns(spark):
    docs, labels = tables(spark)
    model = toxicity.fit(docs, labels, toxicity.Limits(epochs=120))
    wide = docs.selectExpr("*", "1 as score", "'x' as y")
    kept = toxicity.keep_clean(wide, model)
    assert kept.schema == wide.schema
    want = {r["doc_id"] for r in toxicity.score(docs, model).where("score < 0.7").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_scores_are_the_plain_sum_over_pairs():
    rng = np.random.default_rng(3)
    texts = ["a great idiot group", "group idiot idiot people", "", None, "some wonderful people", "é ü"]
    data, at = utf8(pa.array(texts))
    text, slot = toxicity.term_slots(data, at)
    slots = np.unique(slot)[::2]
    model = toxicity.Model(slots, rng.normal(size=len(slots)), rng.normal(0, 0.3, (len(slots), 4)), -0.4)
    place = {s: k for k, s in enumerate(slots)}
    want = []
    for i in range(len(texts)):
        terms = sorted({place[s] for s in slot[text == i] if s in place})
        logit = model.constant + sum(model.weights[k] for k in terms)
        logit += sum(model.factors[j] @ model.factors[k] for n, j in enumerate(terms) for k in terms[n + 1 :])
        want.append(1 / (1 + np.exp(-logit)))
    assert np.allclose(toxicity.scorer(model)(pa.array(texts)), want)
