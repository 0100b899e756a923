"""Counters of stored posts are those that Spark makes of the same rows."""

from __future__ import annotations

import pytest

from tests.conftest import SF_SMALL
from trendloom.operators import mentions as m
from trendloom.plans import testdata as td

SCHEMA = (
    "id long, text string, username string, created_at timestamp_ntz, likes int, retweets int, replies int, "
    "is_retweet boolean, hashtags array<string>"
)


@pytest.mark.parametrize("fold", [1, 500_000])
def test_odd_posts(spark, tmp_path, monkeypatch, fold):
    """No author, no time, no engagement, negative engagement, retweets, no text, one key in two families."""
    monkeypatch.setattr(m, "FOLD_ROWS", fold)
    rows = [
        (1, "$TSLA copper sold copper", "a", None, 1, 0, 0, False, ["Copper", "copper"]),
        (2, "copper sold", None, None, None, 0, 0, False, ["copper"]),
        (3, "copper sold", "b", None, -7, -1, 0, False, None),
        (4, None, "b", None, 2, 2, 2, False, ["copper"]),
        (5, "copper sold", "c", None, 5, 5, 5, True, ["copper"]),
        (6, "lonely silver", None, None, None, None, None, False, []),
        (7, "$TSLA $TSLA wheat", "d", None, 2**31 - 1, 2**31 - 1, 2**31 - 1, False, ["Wheat"]),
    ]
    memory = spark.createDataFrame(rows, SCHEMA)
    memory.repartition(3).write.parquet(f"{tmp_path}/posts")
    stored = spark.read.schema(memory.schema).parquet(f"{tmp_path}/posts")
    got, want = (m.term_stats(m.mentions(df)) for df in (stored, memory))
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)
    assert m.term_stats(m.mentions(stored.where("id < 0"))).collect() == []


def test_terms_are_grouped_once(spark):
    """Rows of a term were grouped four times over, in tables of nearly as many groups as rows."""
    stats = m.term_stats(m.mentions(td.derived(spark, SF_SMALL, "posts")))
    assert "HashAggregate" not in stats._jdf.queryExecution().executedPlan().toString()


def test_unsupported_terms_stay_in_their_task(spark):
    rows = m.mentions(td.derived(spark, SF_SMALL, "posts"))
    got, all_terms = m.supported_stats(rows, 4, 3), m.term_stats(rows)
    assert sorted(got.collect()) == sorted(m.supported(all_terms, 4, 3).collect())
    assert "Filter" not in got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert got.count() < all_terms.count() / 20
