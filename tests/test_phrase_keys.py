"""Phrases with one rarest word in common meet only the places where their other words stand too."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from trendloom.operators import phrases


def test_phrases_of_one_anchor_are_joined_on_their_neighbours(spark):
    """A hundred phrases around each of few words: a join on the word alone would make all pairs."""
    word = lambda n, k: F.concat(F.lit(n), (F.col("id") % k).cast("string"))
    posts = spark.range(600).select("id", F.concat_ws(" ", word("a", 100), word("b", 2), word("c", 3), word("d", 7)).alias("text"))
    listed = posts.select(F.explode(F.array(F.substring_index("text", " ", 2), F.substring_index("text", " ", 3), F.col("text"))).alias("phrase"))
    listed = listed.distinct()
    hits = phrases.phrase_hits(posts, listed)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, \(.*_key#\d+ = _key#\d+", plan)
    phrase_set = {r.phrase for r in listed.collect()}
    texts = {r.id: f" {r.text} " for r in posts.collect()}
    expected = {(i, p) for i, t in texts.items() for p in phrase_set if f" {p} " in t}
    assert {(r.id, r.phrase) for r in hits.collect()} == expected
