from __future__ import annotations

import datetime as dt
import json

from trendloom.operators import ranking
from trendloom.sources import posts as source


def test_raw_posts(spark, tmp_path):
    rows = [
        {"id": 1, "rawContent": "RT @a: hi", "user": {"username": "u", "displayname": "U"}, "date": "2024-01-01T08:00:00",
         "likeCount": 5, "lang": "en", "hashtags": ["x"]},
        {"id": 2, "rawContent": None, "user": None, "date": "2024-01-01T09:00:00", "viewCount": 7},
    ]
    (tmp_path / "p.json").write_text("\n".join(json.dumps(r) for r in rows))
    first, second = source.read_raw_posts(spark, str(tmp_path)).orderBy("id").collect()
    assert (first.is_retweet, first.likes, first.retweets, first.hashtags) == (True, 5, 0, ["x"])
    assert first.created_at == dt.datetime(2024, 1, 1, 8)
    assert (second.username, second.display_name, second.is_retweet) == ("unknown", "Unknown", False)
    assert (second.text, second.views, second.hashtags, second.likes) == (None, 7, [], 0)


def saved_post(n, **changes):
    post = {
        "id": n, "text": f"post {n}", "username": "u", "display_name": "U", "created_at": "2024-01-01T08:00:00.123456",
        "likes": 1, "retweets": 2, "replies": 3, "views": None, "language": "en", "hashtags": ["a"], "is_retweet": False,
    }
    post.update(changes)
    return post


def test_saved_run_state(spark, tmp_path):
    old = saved_post(2)
    del old["display_name"], old["hashtags"]
    state = {
        "run_id": "20240101", "started_at": "x", "step1_complete": True, "topics_completed": ["t"],
        "broad_tweets": [saved_post(1), old], "trends": ["$A"],
        "trend_tweets": {"$A": [saved_post(3)], "b": [saved_post(3), saved_post(4)], "none": []},
    }
    (tmp_path / "state.json").write_text(json.dumps(state, indent=2))
    states = source.read_run_states(spark, str(tmp_path))
    broad = {r.id: r for r in source.state_posts(states).collect()}
    assert broad[1].created_at == dt.datetime(2024, 1, 1, 8, 0, 0, 123456)
    assert (broad[2].display_name, broad[2].hashtags) == ("Unknown", [])
    per_trend = {(r.trend, r.id) for r in source.state_trend_posts(states).collect()}
    assert per_trend == {("$A", 3), ("b", 3), ("b", 4)}
    lines, _ = source.state_to_json(source.state_posts(states), source.state_trend_posts(states))
    assert {json.loads(r.value)["id"] for r in lines.collect()} == {1, 2}


POST = "id LONG, text STRING, created_at TIMESTAMP_NTZ, language STRING, topic STRING"


def posts(spark, *rows):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(i, t, at + dt.timedelta(minutes=i), lang, topic) for i, t, lang, topic in rows], POST
    )


def test_newest_posts_per_topic(spark):
    df = posts(spark, *[(i, "x", "en", "a") for i in range(9)], (50, "x", "de", "a"), (3, "x", "en", "b"))
    got = {(r.topic, r.id) for r in source.select_per_topic(df, 3).collect()}
    assert got == {("a", 8), ("a", 7), ("a", 6), ("b", 3)}


def test_outstanding_topics(spark):
    topics = spark.createDataFrame([("a",), ("b",), ("c",)], "topic STRING")
    status = spark.createDataFrame([("a", "complete"), ("b", "retry")], "topic STRING, status STRING")
    assert {r.topic for r in source.outstanding_topics(topics, status).collect()} == {"b", "c"}


def test_topic_matches_whole_words(spark):
    df = posts(
        spark,
        (1, "Egg SHORTAGE, sold out!", "en", "-"),
        (2, "shortages everywhere", "en", "-"),
        (3, "it sold   out: freight delays", "en", "-"),
        (4, "", "en", "-"),
    )
    topics = spark.createDataFrame([("shortage OR sold out",), ("freight OR port congestion today",)], "topic STRING")
    expected = {(1, "shortage OR sold out"), (3, "shortage OR sold out"), (3, "freight OR port congestion today")}
    assert {(r.id, r.topic) for r in ranking.topic_matches(df, topics).collect()} == expected


def test_trend_posts_and_merge(spark):
    df = posts(spark, *[(i, "buy $NVDA now", "en", "-") for i in range(6)], (9, "$NVDAX egg shortage", "en", "-"))
    trends = spark.createDataFrame([("$NVDA",), ("Egg Shortage",), ("#none",)], "term STRING")
    got = {(r.trend, r.id, r.post_rank) for r in ranking.trend_posts(df, trends, 2).collect()}
    assert got == {("$NVDA", 5, 1), ("$NVDA", 4, 2), ("Egg Shortage", 9, 1)}
    old = spark.createDataFrame([("a", 1), ("b", 2)], "trend STRING, id LONG")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "trend STRING, id LONG")
    merged = {(r.trend, r.id) for r in ranking.merged_trend_posts(old, new).collect()}
    assert merged == {("a", 1), ("b", 3), ("c", 4)}


def test_dedupe(spark):
    df = posts(spark, (1, "x", "en", "b"), (1, "x", "en", "a"), (2, "x", "en", "c"))
    assert {(r.id, r.topic) for r in ranking.dedupe_posts(df).collect()} == {(1, "a"), (2, "c")}


def test_attempts_count_empty_topics(spark):
    from trendloom.operators import health

    topics = spark.createDataFrame([("a",), ("b",)], "topic STRING")
    df = posts(spark, (1, "x", "en", "a"), (2, "x", "en", "a"))
    rows = health.attempt_rows(topics, df, dt.date(2024, 1, 1), 2).collect()
    assert {(r.topic, r.n_posts, r.attempt) for r in rows} == {("a", 2, 2), ("b", 0, 2)}


def test_phrases_inside_quotes_and_hyphens(spark):
    df = spark.createDataFrame(
        [(1, "an 'egg shortage'"), (2, "egg-shortage now"), (3, "it's 'short'"), (4, "eggs shortages"), (5, "'egg-shortage'")], "id LONG, text STRING"
    )
    topics = spark.createDataFrame([("shortage",), ("egg-shortage",), ("it's",), ("short",)], "topic STRING")
    got = {(r.id, r.topic) for r in ranking.topic_matches(df, topics).collect()}
    assert got == {(i, t) for i in (1, 2, 5) for t in ("shortage", "egg-shortage")} | {(3, "it's"), (3, "short")}
