"""Very few phrases are sought in whole texts, a few by their longest words; both find what many find."""

from __future__ import annotations

import pytest

from trendloom.operators import phrases as ph


@pytest.mark.parametrize("listed", [0, 50])
def test_same_posts_by_every_way(spark, monkeypatch, listed):
    texts = ["gold up, gold-up", "the egg shortage is worse", "eggs shortage", "", "--", None, "a b a b a", "'copper' $FCX s&p 500", "copperx $fcx"]
    posts = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "id long, text string")
    some = ["gold up", "egg shortage", "", "a b a", "a", "nowhere", "s&p 500", "copper $fcx", None, "up gold", "gold up"]
    phrases = spark.createDataFrame([(f"{n}", p) for n, p in enumerate(some)], "trend string, phrase string")
    want = sorted(ph.phrase_hits(posts, phrases).collect())
    monkeypatch.setattr(ph, "LISTED_PHRASES", listed)
    hits = ph.phrase_hits(posts, phrases, len(some))
    assert sorted(tuple(r[c] for c in ("phrase", "id", "trend")) for r in hits.collect()) == sorted(tuple(r[c] for c in ("phrase", "id", "trend")) for r in want)
    assert len(want) == 10 and hits.columns == ph.phrase_hits(posts, phrases).columns


def test_no_row_for_each_word(spark):
    """A row and a slice of neighbours for each word of each post took half of the time of a deep dive."""
    posts = spark.createDataFrame([(1, "gold up")], "id long, text string")
    phrases = spark.createDataFrame([("gold",)], "phrase string")
    plan = ph.phrase_hits(posts, phrases, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "slice" not in plan
