from __future__ import annotations

import hashlib
import random
import re

import pytest
from tests.llm.data import ROWS, documents, empty

from trendloom.llm import pii


def brute(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_base_spans_like_the_patterns():
    rng = random.Random(3)
    pool = [*"0123456789..  --++@@()ab_%é\n", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 555-1234", "a@b.co", "255.", "4111111111111111", "0"]
    found = 0
    for _ in range(15_000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))
        want = brute(text)
        found += len(want)
        assert pii.base_spans(text) == want
    assert found > 10_000


@pytest.mark.parametrize("text", ["0" * 50_000, "1-" * 30_000, "a" * 50_000 + "@", "@" * 50_000, "+1" * 30_000, "a." * 30_000, "1." * 30_000, "a@b" * 20_000])
def test_long_runs_take_linear_time(text):
    pii.base_spans(text)
    pii.proposals(text)


SECRET = "key 4f9d"
LINES = [
    ('set token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here', "secret"),
    ("my SSN 123-45-6789 is", "ssn"),
    ("plain words only", None),
    ("the number 12345678901 stood", None),
]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, text, "en", "a", len(text)) for i, (text, _) in enumerate(LINES)] + ROWS
    return pii.fit(documents(spark, rows), pii.Limits(documents=50))


@pytest.mark.parametrize(("text", "kind"), LINES)
def test_chosen_kinds(model, text, kind):
    assert [s[0] for s in model.choose(text, pii.base_spans(text))] == ([kind] if kind else [])


def test_added_spans_overlap_nothing(model):
    rng = random.Random(8)
    made = [t for t, _, _ in pii.examples(300)]
    for _ in range(100):
        text = " ".join(rng.sample(made, 4)) + " a@b.co +1 555 555 1234"
        base = pii.base_spans(text)
        spans = sorted((a, b) for _, a, b in model.choose(text, base))
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert all(b <= c or a >= d for a, b in spans for _, c, d in base)


def test_held_out_precision(model):
    made = pii.examples(2600)[1300:]
    hit = [(y, bool([s for s in model.choose(t, pii.base_spans(t)) if s[0] == kind])) for t, kind, y in made]
    chosen = [y for y, c in hit if c]
    assert len(chosen) > 200 and sum(chosen) / len(chosen) > 0.95


def test_find(spark, model):
    rows = ROWS + [(50 + i, t, "en", "a", len(t)) for i, (t, _) in enumerate(LINES)]
    got = pii.digests(pii.find(documents(spark, rows), model)).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows if r[0] != 9}
    for r in got:
        if r["doc_id"] not in texts:
            continue
        base = brute(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert r["spans"].startswith(joined)
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in base) for k in pii.BASE_KINDS]
    assert pii.find(empty(spark), model).count() == 0


def test_redact(spark, model):
    docs = documents(spark)
    out = pii.redact(docs, model)
    assert out.schema == docs.schema and out.count() == docs.count()
    row = out.where("doc_id = 10").first()
    assert row["text"] == "mail me: [EMAIL] or [PHONE], [CARD], [IP]" and row["n_chars"] == len(row["text"])
    assert out.where("doc_id = 3").first()["text"] is None
    assert pii.redacted("abcdef", [("email", 1, 4), ("ip", 2, 5)]) == "a[EMAIL]f"


def test_fit_without_documents(spark):
    assert "secret" in pii.fit(empty(spark)).thresholds


@pytest.mark.parametrize("text", ["Tel. 030 1234567", "please call 555 123 4567 now", "mobile 555-123-4567"])
def test_numbers_after_phone_words(model, text):
    assert [s[0] for s in model.choose(text, [])] == ["number"]
    assert [r[2] for r in pii._rows_of(text, 20)] == [1.0]


def test_at_in_capitals():
    assert [s[0] for s in pii.proposals("JO.DOE [AT] MAIL [DOT] ORG")] == ["spelled_email"]


def test_long_tokens_leave_room_for_other_kinds():
    text = " ".join(f"{i:02}abcdefghijklmnopq{i}" for i in range(40)) + " SSN 123-45-6789 and IBAN DE12 3456 7890 1234 5678"
    fitted = [r[0] for r in pii._rows_of(text, 20) if r[3]]
    assert len(fitted) == 20 and {"secret", "ssn", "iban"} <= set(fitted)


def test_thresholds_from_all_documents(spark):
    """The sample has one document; the others count too."""
    rows = [(i, f'the token = "a{i:039x}" stood', "en", "a", 60) for i in range(300)]
    seen = []
    calibrated = pii._calibrated
    pii._calibrated = lambda counts, precision: seen.append(counts) or calibrated(counts, precision)
    try:
        pii.fit(documents(spark, rows), pii.Limits(documents=1))
    finally:
        pii._calibrated = calibrated
    assert sum(n for (kind, _, _), n in seen[0].items() if kind == "secret") >= 299
