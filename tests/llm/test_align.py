from __future__ import annotations

import hashlib
from collections import Counter
from functools import cache

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.conftest import SF_SMALL
from tests.llm.data import documents, empty
from tokenizers import Tokenizer

from trendloom.llm import align, queries
from trendloom.llm.common import table

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
PARTS = st.lists(
    st.sampled_from(
        ["word", "a", "'re", "é", "日本", "語", "😀", "​", "ﬁ", " ", " ", " ", "  ", "\n", "\t", "\x00", "\x1c", "\xa0", "　", "1", "2024", "!!", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "▁", "é", "x" * 40]
    ),
    max_size=14,
).map("".join)


@cache
def plain_tools():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    return a, b, align.byte_level(a).texts, align.sentence_pieces(b).texts


def plain(text):
    """Ids of both sides by group, from the whole text and its decoded bytes alone."""
    if not text:
        return None
    a, b, a_bytes, b_bytes = plain_tools()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw = (" " + text).encode()
    if b"".join(a_bytes[i] for i in ids_a) != raw or b"".join(b_bytes[i] for i in ids_b) != raw:
        return None
    ends = []
    for ids, texts in ((ids_a, a_bytes), (ids_b, b_bytes)):
        at, mine = 0, []
        for i in ids:
            at += len(texts[i])
            mine.append(at)
        ends.append(mine)
    out, at_a, at_b = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        to_a, to_b = ends[0].index(cut, at_a) + 1, ends[1].index(cut, at_b) + 1
        out.append((ids_a[at_a:to_a], ids_b[at_b:to_b]))
        at_a, at_b = to_a, to_b
    return out


def shown(found):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)


def brute(rows):
    """The result for (doc_id, text) rows."""
    found = [plain(t) for _, t in rows]
    linked = [Counter((a, b) for ga, gb in f or () for a in ga for b in gb) for f in found]
    counts = Counter(p for pairs in linked for p in pairs)
    top: dict = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for (doc_id, _), f, pairs in zip(rows, found, linked):
        f = f or []
        out.append((
            doc_id, sum(len(a) for a, _ in f), sum(len(b) for _, b in f), len(f), sum(pairs.values()),
            sum(k for (a, b), k in pairs.items() if counts[a, b] == top[a]), sum(k * counts[p] for p, k in pairs.items()),
            hashlib.sha256(shown(f).encode()).hexdigest() if f else "",
        ))
    return out


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(df):
    return sorted(([r[c] for c in NAMES] for r in df.collect()), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=5))
def test_blocks_against_whole_texts(texts):
    block = align.Block(align._aligner(A, B), texts)
    for text, row in zip(texts, block.rows):
        found = plain(text)
        want = (sum(len(a) for a, _ in found), sum(len(b) for _, b in found), len(found)) if found else (0, 0, 0)
        assert row[:3] == want
        assert row[4] == (hashlib.sha256(shown(found).encode()).hexdigest() if found else "")
        linked, often = align._unpacked(row[6], row[7], row[5])
        got = {(int(k) >> 24, int(k) & 0xFFFFFF): int(n) for k, n in zip(block.keys[linked], often)}
        assert got == Counter((a, b) for ga, gb in found or () for a in ga for b in gb)


def test_large_groups(monkeypatch):
    monkeypatch.setattr(align, "_LISTED_PAIRS", 1)
    texts = ["日本語の長い文章 😀😀 instantaneousness", "xxxxxxxxxxxxx yyyyyyyy zzzzz"]
    block = align.Block(align.Aligner(A, B), texts)
    for text, row in zip(texts, block.rows):
        linked, often = align._unpacked(row[6], row[7], row[5])
        got = {(int(k) >> 24, int(k) & 0xFFFFFF): int(n) for k, n in zip(block.keys[linked], often)}
        assert got == Counter((a, b) for ga, gb in plain(text) for a in ga for b in gb)


def test_words_leave_the_cache(monkeypatch):
    monkeypatch.setattr(align, "KEPT_WORDS", 3)
    aligner = align.Aligner(A, B)
    words = [f"w{i % 9}" for i in range(40)]
    first = [aligner.words([w])[0] for w in words]
    assert first == align.Aligner(A, B).words(words)
    assert len(aligner.old) + len(aligner.young) <= 10


def test_wide_numbers_are_packed():
    import numpy as np

    places, times = np.array([3, 70_000, 70_001, 9_000_000]), np.array([1, 255, 256, 1 << 40])
    steps, often = align._packed(places, times)
    got = align._unpacked(steps, often, 4)
    assert [list(x) for x in got] == [list(places), list(times)]


@pytest.mark.parametrize("size", [200, 4 << 20])
def test_awkward_rows(spark, monkeypatch, size):
    monkeypatch.setattr(align, "BLOCK_BYTES", size)
    df = documents(spark)
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert rows_of(align.alignments(df, A, B)) == sorted(map(list, want), key=repr)
    assert align.alignments(empty(spark), A, B).count() == 0


def test_groups(spark):
    rows = [(1, "hello world, 日本😀"), (2, None), (3, "a ▁ b"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'g' as groups")
    got = {r.doc_id: r.groups for r in align.groups(df, A, B).collect()}
    assert got[3] is None and got[2] == []
    assert [(g.a, g.b) for g in got[1]] == plain(rows[0][1])
    assert [g.start for g in got[1]] == [0, *(g.end for g in got[1][:-1])]
    assert got[1][-1].end == len((" " + rows[0][1]).encode())


def test_query_against_whole_texts(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF_SMALL, "documents").collect()]
    got = rows_of(queries.QUERIES["op13_span_alignment"](spark, SF_SMALL))
    assert got == sorted(map(list, brute(docs)), key=repr)
