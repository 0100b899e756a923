from __future__ import annotations

import hashlib

from hypothesis import given
from hypothesis import strategies as st
from tests.compare import compare, connect
from tests.conftest import SF_SMALL

from trendloom.llm import chat, queries

PARTS = st.lists(st.sampled_from(["###", "</turn>", "\\", "\n", "#", "<", " ", ": ", "user", "a", "### user: ", "\n</turn>\n", "é"]), max_size=12).map("".join)


@given(PARTS, PARTS)
def test_a_turn_reads_back(role, text):
    formatted, start, end = chat.render(role, text)
    assert chat.parse(formatted) == [(role, text)]
    assert chat.unescape(formatted[start:end]) == text


@given(st.lists(st.tuples(PARTS, PARTS), max_size=4))
def test_a_conversation_reads_back(turns):
    assert chat.parse("".join(chat.render(*t)[0] for t in turns)) == turns


def test_escapes_only_where_needed():
    assert chat.render("user", "plain \\ text")[0] == "### user: plain \\ text\n</turn>\n"
    assert chat.render("user", "a ### b")[0] == "### user: a \\### b\n</turn>\n"


def test_broken_text_is_no_conversation():
    assert chat.parse("### user: a ### b\n</turn>\n") is None
    assert chat.parse("hello") is None
    assert chat.parse("### user: a") is None


def test_read_back(spark):
    rows = [
        (1, 2, "assistant", "yes </turn>"), (1, 1, "user", "ok?"), (1, 3, "assistant", None), (2, 0, None, ""),
        (2, 0, None, ""), (None, 1, "user", "no id"), (3, None, "user", "first"), (3, 0, "assistant", "second"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as formatted", "1 as loss_start")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    want = {1: [("user", "ok?"), ("assistant", "yes </turn>"), ("assistant", "")], 2: [("", ""), ("", "")], None: [("user", "no id")], 3: [("user", "first"), ("assistant", "second")]}
    assert set(got) == set(want)
    for conv_id, turns in want.items():
        r = got[conv_id]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(chat.render(*t)[0]) for t in turns)
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_query(spark):
    name = "op6_chat_round_trip"
    assert compare(queries.QUERIES[name](spark, SF_SMALL), connect(SF_SMALL), queries.ORACLES[name]) is None
