from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from tests.llm.data import ROWS, documents, empty

from trendloom.llm import repeats
from trendloom.llm.common import table


def covered(docs, length):
    """For documents in order: which bytes lie in a string seen before."""
    seen, out = set(), []
    for raw in docs:
        marks = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                marks[p : p + length] = b"\1" * length
            seen.add(s)
        out.append(bytes(marks))
    return out


def random_corpus(rng):
    letters = rng.choice([b"ab", b"abc", b"a", bytes(range(97, 117))])
    make = lambda n: bytes(rng.choice(letters) for _ in range(n))
    passages = [make(rng.randint(5, 60)) for _ in range(4)]
    return [b"".join(rng.choice([make(rng.randint(0, 30)), rng.choice(passages)]) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 10))]


def test_runs_and_sorting_like_brute_force(monkeypatch):
    rng = random.Random(5)
    for turn in range(600):
        rule = repeats.Rule(length=rng.choice([10, 12, 20]), anchor=rng.choice([3, 4, 6]), shallow=rng.choice([0, 4, 8, 16]))
        monkeypatch.setattr(repeats, "PART", rng.choice([7, 33, 1 << 20]))
        docs = random_corpus(rng)
        at = np.cumsum([0, *map(len, docs)])
        groups: dict[int, list] = {}
        for t, begin, count, offset, h in zip(*repeats.runs(np.frombuffer(b"".join(docs), np.uint8), at, rule)):
            raw = docs[t][begin : begin + count + rule.length - 1]
            groups.setdefault(int(h), []).append(((int(t), 0), int(begin), raw, int(offset), int(count)))
        got = [bytearray(len(d)) for d in docs]
        for group in groups.values():
            for (doc, _), a, b in repeats.repeated(group, rule):
                got[doc][a:b] = b"\1" * (b - a)
        assert [bytes(x) for x in got] == covered(docs, rule.length)


def test_sorts():
    rng = random.Random(6)
    for _ in range(600):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 14))]
        for order in (repeats.blind_trie(list(range(len(texts))), texts), multikey(texts, rng.choice([0, 8, 16]))):
            assert sorted(order) == list(range(len(texts)))
            assert [texts[i] for i in order] == sorted(texts)


def multikey(texts, shallow):
    order: list[int] = []
    repeats.multikey(list(range(len(texts))), texts, 0, repeats.Rule(shallow=shallow), order)
    return order


def brute(rows, length=100):
    keyed = {((r[0] is None, r[0] or 0), (r[1] or "").encode()): None for r in rows}
    order = sorted(keyed)
    marks = dict(zip(order, covered([t for _, t in order], length)))
    out = []
    for r in rows:
        raw = (r[1] or "").encode()
        m = marks[((r[0] is None, r[0] or 0), raw)]
        spans = sum(1 for i, c in enumerate(m) if c and not (i and m[i - 1]))
        kept = bytes(b for b, c in zip(raw, m) if not c)
        out.append((r[0], len(raw), sum(m), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


ODD = [
    (1, "ab" * 200), (2, "ab" * 200), (2, "ab" * 200), (3, None), (4, ""), (None, "ab" * 200 + "zz"), (5, "é" * 90 + "q" * 150),
    (6, "k" + "é" * 90 + "q" * 150), (7, "short"), (7, "short"), (8, "é" * 90 + "q" * 150 + "ab" * 200), (9, ("é" * 90 + "q" * 150)[:95]),
]


@pytest.mark.parametrize("rule", [repeats.Rule(), repeats.Rule(hot_runs=1), repeats.Rule(length=60, anchor=20, shallow=24, hot_runs=3)])
def test_digests(spark, rule):
    rows = [(i, t, "en", "a", 0) for i, t in ODD]
    docs = documents(spark, rows)
    got = repeats.digests(docs, repeats.spans(docs, rule)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, rule.length)


def test_awkward_rows(spark):
    docs = documents(spark, [r for r in ROWS if r[0] != 8])
    rows = [tuple(r)[:2] for r in docs.select("doc_id", "text").collect()]
    got = repeats.digests(docs, repeats.spans(docs)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    assert repeats.digests(empty(spark), repeats.spans(empty(spark))).count() == 0


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = repeats.digests(docs, repeats.spans(docs)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_without_repeats(spark):
    rows = [(i, t, "en", "a", len(t or "")) for i, t in ODD]
    docs = documents(spark, rows)
    out = repeats.without_repeats(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    texts = {r["doc_id"]: r for r in out.collect()}
    assert texts[1]["text"] == "ab" and texts[2]["text"] == "" and texts[3]["text"] is None
    assert texts[8]["text"] == "" and texts[7]["text"] == "short"
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values() if r["text"] is not None)


def test_merged_spans():
    assert repeats.merged(np.array([[0, 5], [5, 7], [9, 12], [10, 11]])).tolist() == [[0, 7], [9, 12]]


@pytest.mark.parametrize("doc_id", [None, 4])
def test_many_rows_of_one_id(spark, doc_id):
    """3,000 random texts of one id, or without, half of them with a common passage."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = lambda n: "".join(rng.choices(letters, k=n))
    passage = noise(120)
    texts = [noise(110) + ("1" + passage + "2" if i % 2 else noise(122)) + noise(20) for i in range(3000)]
    df = spark.createDataFrame([(doc_id, t) for t in texts], "doc_id long, text string")
    found = repeats.digests(df, repeats.spans(df)).collect()
    assert len(found) == 3000
    assert sum(r.n_removed > 0 for r in found) == 1499
    kept = sorted(r.text for r in repeats.without_repeats(df).collect())
    whole = sorted(t for t in texts if passage not in t)
    assert sorted(t for t in kept if t in set(texts)) == sorted([*whole, *(t for t in kept if passage in t)])
    assert sum(passage in t for t in kept) == 1
