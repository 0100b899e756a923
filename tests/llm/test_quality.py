from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.conftest import SF_SMALL
from tests.llm.data import documents, empty

from trendloom.llm import common, quality, queries
from trendloom.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(
    st.none() | st.lists(st.sampled_from(["a", "b", "A", "é", "日本", "\U0001f600", " ", "  ", "\n", "\t", "#", "<>", "\x1c", "\xa0"]), max_size=40).map("".join),
    max_size=6,
)


def counted(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def buckets(text, rule=quality.DEFAULT):
    raw = text.encode()
    out = []
    for i in range(len(raw) - rule.n + 1):
        h = 0
        for b in raw[i : i + rule.n]:
            h = h * 257 + b
        out.append((h * 0x9E3779B97F4A7C15 % 2**64) >> (64 - rule.bits))
    return out


def ratios_of(texts, trusted, rule=quality.DEFAULT):
    size = 1 << rule.bits
    raw = Counter(b for t in texts for b in buckets(t))
    target = Counter(b for t, good in zip(texts, trusted) if good for b in buckets(t))
    n_raw, n_target = sum(raw.values()), sum(target.values())
    out = {}
    for b in raw:
        share = (raw[b] + 1) / (n_raw + size)
        out[b] = round((math.log((target[b] + rule.smoothing * share) / (n_target + rule.smoothing)) - math.log(share)) * 2**20)
    return out


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.booleans())
def test_counts_of_texts(texts, small):
    ratios = np.zeros(1 << 16, np.int64)
    with pytest.MonkeyPatch.context() as patch:
        if small:
            patch.setattr(quality, "BLOCK", 8)
            patch.setattr(common, "BLOCK", 8)
        got = list(zip(*(c.to_pylist() for c in quality.measured(pa.array(texts, pa.string()), ratios))))
    assert [r[:5] for r in got] == [counted(t or "") for t in texts]


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.booleans())
def test_sums_of_log_ratios(texts, small):
    ratios = np.arange(1 << 16) - 30_000
    data, at = common.utf8(pa.array(texts, pa.string()))
    with pytest.MonkeyPatch.context() as patch:
        if small:
            patch.setattr(quality, "BLOCK", 8)
        sums, n = quality.likelihoods(data, at, ratios, quality.DEFAULT)
    want = [buckets(t or "") for t in texts]
    assert list(n) == [len(b) for b in want]
    assert list(sums) == [sum(int(ratios[b]) for b in bs) for bs in want]


def test_query_against_loops(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, SF_SMALL, "documents").collect()}
    good = {r.doc_id for r in table(spark, SF_SMALL, "labels").where("quality = 1").collect()}
    ratios = ratios_of(docs.values(), [d in good for d in docs])
    got = queries.QUERIES["op12_ngram_quality"](spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        n_words, *rest, n_repeat = counted(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, *rest, n_repeat)
        assert r.base_failed == (n_words < 50 or 100 * n_repeat > 50 * n_words)
        own = buckets(docs[r.doc_id])
        total = sum(ratios[b] for b in own)
        assert abs(r.score - total / max(len(own), 1) / 2**20) < 1e-5
        if abs(r.score + 0.5) > 1e-4:
            assert r.kept == (not r.base_failed and r.score >= -0.5)


def test_labels_agree_with_the_verdict(spark):
    sf = SF_SMALL.replace("0.001", "0.01")
    rows = queries.QUERIES["op12_ngram_quality"](spark, sf).join(table(spark, sf, "labels"), "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert not any(r.kept for r in rows if r.quality == 0)


def test_awkward_rows(spark):
    df = documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, 1), (6, 1), (9, 0), (None, 1)], "doc_id long, quality int")
    ratios = quality.fit(df, labels)
    rows = quality.judged(df, ratios).collect()
    source = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted((r.doc_id or -1, r.n_words) for r in rows) == sorted((d or -1, counted(t or "")[0]) for d, t in source)
    kept = quality.keep_good(df, ratios)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)
    assert quality.judged(empty(spark), ratios).count() == 0
    nothing = quality.fit(empty(spark), labels.limit(0))
    assert not nothing.any()
    assert not quality.fit(df, labels.limit(0)).any()
