"""Counters of stored posts, dealt to tasks in blocks, are those that Spark makes of a row for each mention."""

from __future__ import annotations

import dataclasses

import pytest

from tests.conftest import SF_SMALL
from tests.test_counted import SCHEMA
from trendloom.functions import text
from trendloom.operators import mentions as m
from trendloom.operators import ranking
from trendloom.plans import testdata as td

ROWS = [
    (1, "$TSLA copper sold copper", "a", None, 1, 0, 0, False, ["Copper", "copper"]),
    (2, "copper sold", None, None, None, 0, 0, False, ["copper"]),
    (3, "copper sold", "b", None, -7, -1, 0, False, None),
    (4, None, "b", None, 2, 2, 2, False, ["copper"]),
    (5, "copper sold", "c", None, 5, 5, 5, True, ["copper"]),
    (6, "lonely silver", None, None, None, None, None, False, []),
    (7, "$TSLA $TSLA wheat", "d", None, 2**31 - 1, 2**31 - 1, 2**31 - 1, False, ["Wheat", None]),
    (8, "", "d", None, 1, 1, 1, False, None),
    (9, "東京 市場 copper sold machine learning", "", None, 1, 1, 1, False, ["市場だ"]),
]


@pytest.mark.parametrize(("block", "row", "fold"), [(1, 1, 1), (5, 2, 7), (1_000_000, 50_000, 2_000_000)])
@pytest.mark.parametrize("types", [m.ALL_TYPES, (m.HASHTAG,), (m.NGRAM, m.CASHTAG)])
def test_odd_posts(spark, tmp_path, monkeypatch, block, row, fold, types):
    for name, value in {"BLOCK_TERMS": block, "ROW_TERMS": row, "FOLD_ROWS": fold}.items():
        monkeypatch.setattr(m, name, value)
    memory = spark.createDataFrame(ROWS, SCHEMA)
    memory.repartition(3).write.parquet(f"{tmp_path}/posts")
    stored = spark.read.schema(memory.schema).parquet(f"{tmp_path}/posts")
    got, want = m.post_stats(stored, types), m.term_stats(m.mentions(memory, types))
    assert got.dtypes == want.dtypes
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr) != []
    assert sorted(m.post_stats(memory, types).collect(), key=repr) == sorted(want.collect(), key=repr)
    assert m.post_stats(stored.where("id < 0"), types).collect() == []


@pytest.mark.parametrize("rules", [text.DEFAULT_RULES, dataclasses.replace(text.DEFAULT_RULES, match="word")])
def test_whole_documents(spark, monkeypatch, rules):
    """Every term is in one task, whichever slice of posts it comes from; unsupported ones stay there."""
    monkeypatch.setattr(m, "GATHER_BYTES", 1 << 13)
    monkeypatch.setattr(m, "BLOCK_TERMS", 10_000)
    posts = td.derived(spark, SF_SMALL, "posts")
    want = m.term_stats(m.mentions(posts, rules=rules))
    assert sorted(m.post_stats(posts, rules=rules).collect()) == sorted(want.collect())
    few = m.supported_post_stats(posts, rules=rules, min_mentions=4, min_authors=3)
    assert sorted(few.collect()) == sorted(m.supported(want, 4, 3).collect())


def test_candidates_make_no_row_for_each_mention(spark):
    """Each mention was a row of its own, shuffled and handed over one by one: most of the time of a trend query."""
    plan = ranking.candidates(td.derived(spark, SF_SMALL, "posts"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan


def test_missing_lists_lose_no_other_terms(spark):
    """Without a list of hashtags a post lost its cashtags and n-grams, and without text its hashtags."""
    rows = m.mentions(spark.createDataFrame(ROWS, SCHEMA).where("id in (3, 4)"))
    assert sorted((r.id, r.term_type, r.key) for r in rows.collect()) == [(3, "ngram", "copper"), (3, "ngram", "copper sold"), (3, "ngram", "sold"), (4, "hashtag", "copper")]
