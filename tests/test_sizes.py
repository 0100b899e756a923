"""Tasks grow with the stored posts, so that each keeps its groups in memory."""

from __future__ import annotations

import re

import pytest

from tests.conftest import SF_SMALL
from trendloom import session
from trendloom.operators import mentions as m
from trendloom.operators import ranking
from trendloom.plans import testdata as td


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(session, "TASK_BYTES", 1 << 14)


def exchanges(df) -> list[tuple[str, int]]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [(keys, int(n)) for keys, n in re.findall(r"Exchange hashpartitioning\(([\w#, ]*?), (\d+)\)", plan)]


def test_tasks_in_proportion_to_the_files(spark, tmp_path, small_tasks):
    cores = spark.sparkContext.defaultParallelism
    docs = td.table(spark, SF_SMALL, "documents")
    docs.where("doc_id % 3 = 0").coalesce(1).write.parquet(f"{tmp_path}/a %20third/documents.parquet")
    third, whole = (session.tasks_for(td.table(spark, d, "documents")) for d in (f"{tmp_path}/a %20third", SF_SMALL))
    assert whole > cores and whole > 1.5 * third
    assert session.tasks_for(spark.range(5)) is None


def test_terms_of_stored_posts_are_shuffled_once(spark, small_tasks):
    posts = td.derived(spark, SF_SMALL, "posts")
    tasks = session.tasks_for(posts)
    assert tasks > spark.sparkContext.defaultParallelism
    rows = m.mentions(posts)
    shuffles = exchanges(m.term_stats(rows))
    assert [n for _, n in shuffles] == [tasks, tasks]  # by term, and the posts dealt to tasks
    assert "username" not in shuffles[0][0]
    best = exchanges(ranking.unique_trends(m.with_scores(m.term_stats(rows))))
    assert [n for _, n in best] == [tasks] * 3
    memory = spark.createDataFrame(posts.collect(), posts.schema)
    assert sorted(m.term_stats(rows).collect()) == sorted(m.term_stats(m.mentions(memory)).collect())


def test_terms_are_grouped_in_smaller_tasks_by_their_key(spark, monkeypatch):
    monkeypatch.setattr(m, "GATHER_BYTES", 1 << 13)
    posts = td.derived(spark, SF_SMALL, "posts")
    tasks = session.tasks_for(posts, 1 << 13)
    assert tasks > session.tasks_for(posts)
    keys, n = exchanges(m.term_stats(m.mentions(posts)))[0]
    assert n == tasks and re.fullmatch(r"key#\d+", keys)


def test_family_of_a_mention_by_its_place(spark):
    row = (1, "$TSLA sold copper", "a", None, 1, 0, 0, False, ["Copper", "sold"])
    schema = "id long, text string, username string, created_at timestamp_ntz, likes int, retweets int, replies int, is_retweet boolean, hashtags array<string>"
    rows = m.mentions(spark.createDataFrame([row], schema), (m.HASHTAG, m.NGRAM), only={m.HASHTAG: ["copper"], m.NGRAM: ["copper"]})
    assert sorted((r.term_type, r.key) for r in rows.collect()) == [("hashtag", "copper"), ("ngram", "copper")]
