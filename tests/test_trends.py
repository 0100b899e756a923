from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from trendloom.operators import market
from trendloom.operators import mentions as m
from trendloom.operators import news, ranking
from trendloom.plans import catalog
from trendloom.session import written

SCHEMA = """id LONG, text STRING, username STRING, created_at TIMESTAMP_NTZ, likes INT, retweets INT, replies INT,
  is_retweet BOOLEAN, hashtags ARRAY<STRING>"""
START = dt.datetime(2024, 1, 1)


def posts(spark, *rows):
    """Rows of (text, author, likes[, hashtags[, retweet]])."""
    data = []
    for i, (text, author, likes, *rest) in enumerate(rows):
        tags, retweet = (*rest, *([], False)[len(rest) :])
        data.append((i, text, author, START + dt.timedelta(hours=i), likes, 0, 0, retweet, tags))
    return spark.createDataFrame(data, SCHEMA)


def stats(df, *types):
    return {(r.term_type, r.key): r for r in m.term_stats(m.mentions(df, types or m.ALL_TYPES)).collect()}


def test_tags_count_occurrences_and_ngrams_count_posts(spark):
    df = posts(
        spark,
        ("$TSLA down $TSLA copper copper", "a", 10, ["Copper", "copper"]),
        ("copper again", "b", 5),
        ("RT @x: $TSLA copper", "c", 99, [], True),
    )
    got = stats(df)
    tsla = got["cashtag", "TSLA"]
    assert (tsla.mention_count, tsla.unique_authors, tsla.total_engagement) == (2, 1, 20.0)
    assert (tsla.financial_context_count, tsla.cashtag_cooccurrence_count) == (2, 0)
    assert got["hashtag", "copper"].mention_count == 2
    word = got["ngram", "copper"]
    assert (word.mention_count, word.unique_authors, word.avg_engagement) == (2, 2, 7.5)
    assert (word.financial_context_count, word.cashtag_cooccurrence_count) == (2, 1)
    assert (word.first_seen, word.last_seen) == (START, START + dt.timedelta(hours=1))


def test_noise_tickers_are_dropped(spark):
    assert set(stats(posts(spark, ("$COST $PLAY $LIKE $NVDA", "a", 1)), m.CASHTAG)) == {("cashtag", "NVDA")}


def test_one_scan_equals_three_passes(spark):
    df = posts(spark, ("$NVDA copper supply deficit #gpu", "a", 3, ["gpu"]), ("copper supply #gpu", "b", 4, ["gpu"]))
    together = stats(df)
    apart = {k: v for t in m.ALL_TYPES for k, v in stats(df, t).items()}
    assert together == apart


def test_samples_are_the_first_three_posts(spark):
    df = posts(spark, *[(f"$NVDA post {i} " + "x" * 300, "a", 1) for i in range(5)])
    rows = m.sample_texts(df, m.mentions(df, (m.CASHTAG,))).first()
    assert [s[:12] for s in rows.sample_tweets] == ["$NVDA post 0", "$NVDA post 1", "$NVDA post 2"]
    assert {len(s) for s in rows.sample_tweets} == {200}


def many(spark, n=12):
    return posts(spark, *[(f"nvda $NVDA supply {'#nvda' if i % 2 else ''}", f"u{i}", 100, ["nvda"]) for i in range(n)])


def test_candidates_keep_one_spelling_per_key(spark):
    got = ranking.candidates(many(spark)).collect()
    keys = [r.term.lower().strip("$#") for r in got]
    assert len(keys) == len(set(keys))
    assert [r.rank for r in got] == list(range(1, len(got) + 1))
    assert [r.composite_score for r in got] == sorted((r.composite_score for r in got), reverse=True)


def test_support_and_quality(spark):
    few = posts(spark, ("$NVDA", "a", 1), ("$NVDA", "a", 1), ("$AMD", "a", 1), ("$NVDA", "b", 1))
    assert [r.term.upper() for r in ranking.candidates(few).collect()] == ["$NVDA"]
    assert ranking.top_terms(few).count() == 0  # two authors are too few for quality
    assert "NVDA" in {r.term.strip("$#").upper() for r in ranking.top_terms(many(spark)).collect()}


def test_fallback_only_when_nothing_qualifies(spark):
    none = spark.createDataFrame([], "rank INT, term STRING")
    assert [r.term for r in ranking.with_fallback(none).orderBy("rank").collect()] == [
        "Federal Reserve", "Stock Market", "Inflation",
    ]
    some = spark.createDataFrame([(1, "$A")], "rank INT, term STRING")
    assert [r.term for r in ranking.with_fallback(some).collect()] == ["$A"]


def test_keep_list_splits_candidates(spark):
    top = spark.createDataFrame([(1, "$A"), (2, "b"), (3, "c")], "rank INT, term STRING")
    keep = spark.createDataFrame([("b",), ("unknown",)], "term STRING")
    assert [r.term for r in ranking.kept(top, keep).collect()] == ["b"]
    assert {r.term for r in ranking.rejected(top, keep).collect()} == {"$A", "c"}


def test_hot_term_is_combined_before_the_shuffle(spark):
    """A term in every post: the aggregation shuffles by (term, author), samples by rank limit."""
    rows = m.mentions(many(spark, 50))
    plan = m.term_stats(rows)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term_type" in plan and "username" in plan.split("hashpartitioning")[1]
    assert "Expand" not in plan
    assert "WindowGroupLimit" in m.first_posts(rows)._jdf.queryExecution().executedPlan().toString()


def test_samples_of_candidates(spark):
    df = many(spark)
    top = written(ranking.candidates(df), "top")
    rows = ranking.with_samples(top, df).collect()
    assert len(rows) == top.count()
    assert all(len(r.sample_tweets) == 3 for r in rows)


def test_news_caps_per_query_then_keeps_first_url(spark):
    rows = [("q1", 0, i, f"T{i}", "b", f"u{i}", "s", "d") for i in range(7)]
    rows += [("q2", 1, 0, None, None, "u1", None, None), ("q2", 1, 1, None, None, "u9", None, None)]
    df = spark.createDataFrame(
        rows, "query STRING, ord INT, rnk LONG, title STRING, body STRING, url STRING, source STRING, date STRING"
    )
    got = {r.url: r for r in news.fetch_news(df).collect()}
    assert set(got) == {"u0", "u1", "u2", "u3", "u4", "u9"}
    assert got["u1"].query == "q1"
    assert (got["u9"].title, got["u9"].source, got["u9"].body) == ("No Title", "Unknown", "")


def test_daily_activity_joins_spellings(spark):
    df = posts(spark, ("$NVDA #nvda", "a", 10, ["nvda"]), ("$NVDA", "b", 5))
    rows = m.daily_activity(m.mentions(df, (m.CASHTAG, m.HASHTAG))).collect()
    assert [(r.trend_term, r.mention_count, r.engagement_score) for r in rows] == [("nvda", 3, 25.0)]


@pytest.mark.parametrize("kind", ["cashtag", "hashtag"])
def test_type_order_breaks_ties(spark, kind):
    order = spark.range(1).select(ranking.type_order(F.lit(kind)).alias("o")).first().o
    assert order == {"cashtag": 0, "hashtag": 1}[kind]


def test_approximate_authors_need_one_shuffle(spark):
    df = many(spark)
    exact = ranking.candidates(df).select("term", "unique_authors").collect()
    limits = ranking.TrendLimits(exact_authors=False)
    assert ranking.candidates(df, limits).select("term", "unique_authors").collect() == exact
    rows = m.mentions(df)
    shuffles = [
        m.term_stats(rows, e)._jdf.queryExecution().executedPlan().toString().count("Exchange hash")
        for e in (True, False)
    ]
    assert shuffles == [2, 1]


def test_a_third_of_all_posts_by_one_author_about_one_term(spark):
    rows = [("$HOT copper", "spam", 1)] * 200 + [(f"$T{'ABCD'[i % 4]} copper", f"u{i}", 2) for i in range(400)]
    got = stats(posts(spark, *rows))
    assert (got["cashtag", "HOT"].mention_count, got["cashtag", "HOT"].unique_authors) == (200, 1)
    assert (got["ngram", "copper"].mention_count, got["ngram", "copper"].unique_authors) == (600, 401)
    assert got["ngram", "copper"].total_engagement == 200 + 800


def test_samples_by_list_equal_samples_by_join(spark, monkeypatch):
    df = many(spark)
    top = written(ranking.candidates(df), "top")
    listed = ranking.with_samples(top, df).select("term", "sample_tweets").orderBy("term").collect()
    monkeypatch.setattr(ranking, "MAX_LISTED_KEYS", 0)
    joined = ranking.with_samples(top, df).select("term", "sample_tweets").orderBy("term").collect()
    assert listed == joined


def test_no_posts(spark):
    none = posts(spark, ("$NVDA", "a", 1)).limit(0)
    top = written(ranking.candidates(none), "top")
    assert ranking.with_samples(top, none).count() == 0
    assert ranking.trend_posts(none.withColumn("topic", F.lit("t")), top).count() == 0


def test_queries_of_all_terms_have_singletons(spark):
    found = {name: catalog.QUERIES[name](spark, SF_SMALL) for name in catalog.QUERIES if name.startswith("all_")}
    assert len(found) == 5
    assert found["all_ngram_trends"].where("mention_count = 1").count() > 0
    assert len({df.count() for df in found.values()}) <= 3 and min(df.count() for df in found.values()) > 50_000


def test_named_symbols_leave_no_place_for_upper_case_names(spark):
    trends = spark.createDataFrame([("$NVDA",), ("ABC1",)], "term string")
    assert [r[0] for r in market.requested_symbols(trends).collect()] == ["NVDA"]
    named = {r[0] for r in catalog.QUERIES["requested_symbols_named"](spark, SF_SMALL).collect()}
    assert "GC=F" in named and not named & {r[0] for r in catalog.QUERIES["requested_symbols"](spark, SF_SMALL).collect()}
