"""Terms by numbers of words are those of the column functions, in the same order."""

from __future__ import annotations

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from trendloom.functions import ngrams, text
from trendloom.operators import mentions as m
from trendloom.plans import testdata as td

ODD = [
    None, "", " ", "|", "a", "the", "of the gold", "gold gold gold gold", "12 345 $5 x9 9x 1_000 #tag $TSLA it's o'neil --",
    "٣٤٥ kawi 𝟙𝟚𝟛 éclair Über straße ÇA 東京 市場 東京 市場", "don't trump the machine learning machine learning rally", "z~~ z~ zz {x} ~~~",
    "one @two https://x.y/z three #four $five six-seven eight_nine ''ten''", "\u0000 nul \u0000 \n new \t tab \u00a0 blank",
]


def both(df, rules):
    words = m.with_term_words(df, rules)
    old = text.ngram_keys(F.col("line"), F.col("inner"), F.col("outer"), rules)
    return words.select("text", old.alias("old"), ngrams.text_keys(F.col("text"), rules).alias("new"))


@pytest.mark.parametrize("rules", [text.DEFAULT_RULES, dataclasses.replace(text.DEFAULT_RULES, match="word"), text.TermRules(noise_terms=("gold rally",), stop_words=())])
@pytest.mark.parametrize("most", [3, 200_000])
def test_same_terms_in_the_same_order(spark, monkeypatch, rules, most):
    monkeypatch.setattr(ngrams, "SLICE_WORDS", most)
    monkeypatch.setattr(ngrams, "PATTERN_TERMS", 7 if most == 3 else 1000)
    rng = random.Random(1)
    some = ["gold", "rally", "the", "of", "machine", "learning", "new", "year", "12", "ab", "abc", "don't", "$TSLA", "#x1", "president", "presidential", "xpresident-", "--", "www.a", "_", "fed-up", "u.s.", "white house"]
    texts = ODD + [" ".join(rng.choice(some) for _ in range(rng.choice([1, 2, 3, 40]))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    rows = both(df, rules).collect()
    assert len(rows) == len(texts) and all(r.old == r.new for r in rows)
    assert both(df.limit(0), rules).collect() == []


def test_same_terms_of_whole_documents(spark):
    posts = td.derived(spark, SF_SMALL, "posts").select("text")
    assert both(posts, text.DEFAULT_RULES).where("not old <=> new").count() == 0


def test_mentions_make_terms_outside_of_interpreted_lambdas(spark):
    """Half of the time of a trend query went into lambdas over the words of each post."""
    plan = m.mentions(td.derived(spark, SF_SMALL, "posts"), (m.NGRAM,))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "zip_with" not in plan
