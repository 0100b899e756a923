from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trendloom.functions import constants, patterns, text
from trendloom.operators import mentions


def values(spark, rows, expr, schema="v STRING"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(expr).collect()]


@pytest.mark.parametrize(
    ("term", "noise"),
    [
        ("the", True), ("trump", True), ("congress", True), ("stock market", True),
        ("shortage", False), ("supply chain", False),
        ("https://example.com", True), ("www.test.com", True),
        ("12345", True), ("99.99%", True), ("$1,000", True), ("x", True),
        # longer noise words match inside words: state, rate, price, work
        ("real estate", True), ("interest rates", True), ("price hike", True), ("network", True),
        ("COST", True), ("NVDA", False),
    ],
)
def test_noise(spark, term, noise):
    assert values(spark, [term], text.is_noise(F.col("v"))) == [noise]


def test_the_whole_vocabulary_is_noise(spark):
    terms = sorted(set(constants.NOISE_TERMS))
    assert len(terms) == len(constants.NOISE_TERMS) == 558
    pinned = "8b071ff6e3625bc626aa55fbd550cbebcbc4cd6533b1559d4459c987aad83fb3"
    assert hashlib.sha256("\n".join(terms).encode()).hexdigest() == pinned
    assert values(spark, terms, text.is_noise(F.col("v"))) == [True] * 558


def test_noise_by_whole_word(spark):
    rules = text.TermRules(match="word")
    terms = ["real estate", "network", "the state", "price hike"]
    assert values(spark, terms, text.is_noise(F.col("v"), rules)) == [False, False, True, True]


def test_own_noise_list(spark, tmp_path):
    (tmp_path / "noise.txt").write_text("Banana\n\nfig\n banana \n")
    terms = text.load_terms(spark, str(tmp_path))
    assert terms == ("banana", "fig")
    rules = text.TermRules(noise_terms=terms)
    found = values(spark, ["bananas", "fig", "figs", "market"], text.is_noise(F.col("v"), rules))
    assert found == [True, True, False, False]
    with pytest.raises(ValueError, match="more than 1"):
        text.load_terms(spark, str(tmp_path), limit=1)


def test_context(spark):
    posts = [
        "$NVDA breaking out!",
        "Market rally continues, bullish momentum building",
        "Just watched an amazing movie!",
        "turmoil downstairs",  # oil, dow
    ]
    assert values(spark, posts, text.has_context(F.col("v"))) == [True, True, False, True]
    rules = text.TermRules(match="word")
    assert values(spark, posts, text.has_context(F.col("v"), rules)) == [True, True, False, False]


def test_clean_text(spark):
    raw = "Check  this https://example.com/a?b @user $NVDA #stocks wow!\nit's co-op café"
    assert values(spark, [raw], text.clean_text(F.col("v"))) == [
        "Check this $NVDA #stocks wow it's co-op café"
    ]


def test_cashtags_keep_repeats_and_word_ends(spark):
    raw = "$tsla up $TSLA, $ABCDEF no, $AB1 no, $Aé no, ($gld) $SPY"
    assert values(spark, [raw], text.cashtags(F.col("v"))) == [["TSLA", "TSLA", "GLD", "SPY"]]


def test_hashtag_keys(spark):
    tags = [["#Silver", "AI", "x" * 26, "stocks", "nvda"]]
    assert values(spark, tags, text.hashtag_keys(F.col("v")), "v ARRAY<STRING>") == [["silver", "nvda"]]


def test_normalized_key(spark):
    assert values(spark, ["$NVDA", "#Silver", "Egg$ Shortage#"], text.normalized_key(F.col("v"))) == [
        "nvda", "silver", "egg$ shortage",
    ]


def ngrams_by_loop(raw: str) -> set[str]:
    """The n-gram rule written as a plain loop."""
    cleaned = re.sub(r"https?://\S+", "", raw)
    cleaned = re.sub(r"@\w+", "", cleaned)
    words = re.sub(r"[^\w$#'-]+", " ", cleaned).strip(" ").lower().split(" ")
    inside = [t for t in constants.NOISE_TERMS if len(t) > 3] + ["http", "www", ".com"]
    alone = {t for t in constants.NOISE_TERMS if len(t) <= 3} | set(constants.STOP_WORDS)

    def bad(w):
        return any(t in w for t in inside) or not re.search(r"[^\W_]", w)

    found = set()
    for n in (1, 2, 3):
        for i in range(len(words) - n + 1):
            run = words[i : i + n]
            if any(map(bad, run)) or any(t in " ".join(run) for t in inside):
                continue
            if n == 1:
                number = re.fullmatch(r"[.,%$\d]*\d[.,%$\d]*", run[0])
                if len(run[0]) < 3 or run[0] in alone or number:
                    continue
            elif run[0] in constants.STOP_WORDS or run[-1] in constants.STOP_WORDS:
                continue
            found.add(" ".join(run))
    return found


WORDS = ["egg", "shortage", "the", "of", "market", "wall", "street", "$nvda", "#gpu", "5090", "up", "-", "us", "don't", "silver", "é"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS), max_size=12).map(" ".join), min_size=1, max_size=20))
def test_ngrams_equal_loop(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "v STRING")
    keys = text.ngram_keys(F.col("line"), F.col("inner"), F.col("outer"))
    words = mentions.with_term_words(df.withColumnRenamed("v", "text"))
    rows = words.select(F.col("text").alias("v"), keys.alias("k")).collect()
    for row in rows:
        assert len(row.k) == len(set(row.k))
        assert set(row.k) == ngrams_by_loop(row.v), row.v


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.text("ab.+ ", min_size=1, max_size=4), min_size=1, max_size=8),
    st.text("ab.+ c", max_size=12),
)
def test_any_of_finds_exactly_the_terms(terms, body):
    assert bool(re.search(patterns.any_of(terms), body)) == any(t in body for t in terms)


def test_any_of_whole_word():
    pattern = patterns.any_of(["gold", "golden age", "oil"], whole_word=True).replace(
        patterns.WORD_CHAR, r"\w"
    )
    assert re.search(pattern, "the golden age")
    assert re.search(pattern, "gold!")
    assert not re.search(pattern, "golden turmoil")
