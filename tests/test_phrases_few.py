"""Few phrases are found without a count of their words, and the same ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.operators import phrases as ph


def test_few_phrases_are_found_by_their_longest_words(spark, monkeypatch):
    texts = ["gold up gold up", "the egg shortage is worse", "egg, shortage!", "egg", "", None, "a b a b a", "nothing", "'copper' $FCX s&p 500"]
    posts = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    some = ["gold up", "egg shortage", "egg", "", "a b a", "a", "nowhere at all", "s&p 500", "copper $fcx s&p", None, "gold up gold up gold"]
    phrases = spark.createDataFrame([(p,) for p in some], "phrase string")
    want = sorted(ph.phrase_hits(posts, phrases).collect())
    assert {r.phrase for r in want} == set(some) - {None, "nowhere at all", "gold up gold up gold"}
    monkeypatch.setattr(ph, "anchors", None)  # no look at the posts
    assert sorted(ph.phrase_hits(posts, phrases, len(some)).collect()) == want
    plan = ph.phrase_hits(posts.withColumn("text", F.upper("text")), phrases, len(some))
    assert sorted(plan.collect()) == want
