from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.compare import compare, connect
from tests.conftest import SF_SMALL

from trendloom.llm import queries, repair

SPACE = " \t\n\x0b\x0c\r"
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ROWS = st.lists(st.tuples(st.sampled_from("suax"), st.integers(0, 3)), max_size=9)


def swept(rows, entry=0, ends=(0, 3), inserts_at_end=True):
    """Cost and audit by a plain sweep over rows that holds the best way into every state."""

    def closed(ways):
        for _ in range(2):
            for s, (cost, audit) in list(ways.items()):
                to = 3 if s == 2 else 2
                ways[to] = min(ways.get(to, (1e9, "")), (cost + 2, audit + "I"))
        return ways

    ways = {entry: (0, "")}
    for initial, fault in rows:
        after = {}
        for s, (cost, audit) in closed(ways).items():
            steps = [(3, "D", s)]
            if fault not in (1, 2):
                more = int(fault == 3)
                if s in NEXT.get(initial, {}):
                    steps.append((more, "K", NEXT[initial][s]))
                steps.append((2 + more, "R", 3 if s == 2 else 2))
            for step, edit, to in steps:
                after[to] = min(after.get(to, (1e9, "")), (cost + step, audit + edit))
        ways = after
    if inserts_at_end:
        ways = closed(ways)
    return min((ways[s] for s in ends if s in ways), default=None)


@settings(max_examples=300, deadline=None)
@given(ROWS)
def test_the_search_finds_the_least_cheapest_audit(rows):
    codes = "".join(repair.code(*r) for r in rows)
    assert repair.Lattice(codes, True).cheapest(0, (0, 3)) == swept(rows)


@settings(max_examples=150, deadline=None)
@given(ROWS, st.integers(0, 3), st.integers(0, 3))
def test_blocks_between_any_states(rows, entry, leave):
    codes = "".join(repair.code(*r) for r in rows)
    assert repair.Lattice(codes, False).cheapest(entry, (leave,)) == swept(rows, entry, (leave,), False)


@settings(max_examples=150, deadline=None)
@given(ROWS, st.integers(1, 3))
def test_chained_blocks_are_the_whole(rows, size):
    codes = "".join(repair.code(*r) for r in rows)
    parts = [codes[i : i + size] for i in range(0, len(codes), size)] or [""]
    chain = repair.Chain()
    for b, part in enumerate(parts):
        last = b == len(parts) - 1
        for entry in range(4):
            for ends in [(0, 3)] if last else [(s,) for s in range(4)]:
                found = repair.Lattice(part, last).cheapest(entry, ends)
                if found:
                    chain.add(b, part, entry, -1 if last else ends[0], *found)
    pieces = list(chain.pieces())
    assert (sum(p[2] for p in pieces), "".join(p[3] for p in pieces)) == swept(rows)


def harmed(rows):
    out = []
    for conv_id, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        harm = zlib.crc32(key.encode()) % 20
        if harm == 1:
            text = ""
        if harm == 2:
            text = "".join(c for c in text if c not in ".!?")
        out += [(conv_id, turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return out


def brute(rows, conversations):
    reports = {}
    for conv_id in conversations:
        mine = sorted((r[1:] for r in rows if r[0] == conv_id), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in mine:
            body = text.rstrip(SPACE)
            faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
            seen.add((role, text))
        cost, audit = swept([(role[:1], fault) for (_, role, _), fault in zip(mine, faults)])
        made, at, state = [], 0, 0
        for edit in audit:
            role, text = (None, "") if edit == "I" else mine[at][1:]
            at += edit != "I"
            if edit == "D":
                continue
            state = NEXT[role[:1]][state] if edit == "K" else 3 if state == 2 else 2
            made.append((role if edit == "K" else ("user", "assistant")[state == 3], text))
        turns = [t for t, _, _ in mine if t is not None]
        initials = [role[:1] for _, role, _ in mine]
        reports[conv_id] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in (1, 2, 3)),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
        )
    return reports


TEXTS = ["Yes.", "Yes.", "No", "What?", "", " \n", None, "Fine!\t", "open end,", "é 日本。", "x" * 5000 + "."]
ROLES = ["user", "assistant", "system", "user", "assistant", None, "", "tool"]


def sample(n, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(12)]), rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(n)]
    rows += [(7, k, ("user", "assistant")[k % 2], f"turn {k}{'.!?,'[k % 4]}") for k in range(90)]
    rows += [(8, None, "user", "Again.")] * 40 + [(9, 4, "system", "Alone.")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("bits", [2, 10])
def test_reports_of_damaged_conversations(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    rows = sample(60, 3)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as place", "1 as block", "2 as kind", "'y' as codes", "0 as harm")
    got = repair.report(repair.damaged(df), df).collect()
    ids = {r[0] for r in rows}
    assert len(got) == len(ids)
    assert {r[0]: tuple(r)[1:] for r in got} == brute(harmed(rows), ids)


def test_repaired_turns(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_BITS", 2)
    rows = sample(40, 5)
    got: dict = {}
    for r in sorted(repair.repaired(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.number):
        assert r.number == len(got.setdefault(r.conv_id, []))
        got[r.conv_id].append((r.role, r.text))
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv_id, report in brute(plain, {r[0] for r in rows}).items():
        turns = got.get(conv_id, [])
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest() == report[-1]
        initials = "".join(r[:1] for r, _ in turns).removeprefix("s")
        assert initials == "ua" * (len(initials) // 2)


def test_without_rows(spark):
    df = spark.createDataFrame([(5, 1, "user", "gone")], SCHEMA)
    got = repair.report(df.limit(0), df).collect()
    assert [tuple(r) for r in got] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.report(df.limit(0)).count() == 0
    assert repair.repaired(df.limit(0)).count() == 0


def test_query(spark):
    name = "op11_lattice_repair"
    assert compare(queries.QUERIES[name](spark, SF_SMALL), connect(SF_SMALL), queries.ORACLES[name]) is None
