"""Digest history, baselines and the daily summary row."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions import patterns, scoring
from trendloom.operators.health import one_row
from trendloom.operators.timeline import in_days


def recent_digests(digests: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    """Digests from as_of - days to as_of, newest first."""
    return digests.where(in_days("run_date", as_of, days)).orderBy(F.desc("run_date"))


def baseline_stats(digests: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Run count, mean engagement and posts, notable days and rate; zeros without runs."""
    runs = F.count(F.lit(1))
    notable = F.count_if("notable")
    return digests.where(in_days("run_date", as_of, days)).agg(
        runs.alias("total_runs"),
        F.coalesce(F.avg("top_engagement"), F.lit(0.0)).alias("avg_top_engagement"),
        F.coalesce(F.avg("tweet_count"), F.lit(0.0)).alias("avg_tweets"),
        notable.alias("notable_days"),
        F.when(runs > 0, notable / F.greatest(runs, F.lit(1))).otherwise(0.0).alias("notable_rate"),
    )


def with_signal(runs: DataFrame, baseline: float = 10000.0) -> DataFrame:
    """Signal strength and notable flag from top engagement and trend count."""
    signal = scoring.signal_strength(F.col("top_engagement"), F.col("trend_count"), baseline)
    return runs.withColumn("signal_strength", signal).withColumn(
        "notable", scoring.is_notable(F.col("signal_strength"))
    )


def context_lines(
    digests: DataFrame, as_of: dt.date, days: int = 7, newest: int = 5, n_trends: int = 3
) -> DataFrame:
    """The newest digests with their first trends, under the 30-day baseline."""
    lines = recent_digests(digests, as_of, days).limit(newest)
    baseline = baseline_stats(digests, as_of)
    return lines.select(
        "run_date",
        F.slice("trends", 1, n_trends).alias("top_trends"),
        "signal_strength",
        "top_engagement",
        "notable",
        baseline.select("total_runs").scalar().alias("total_runs"),
        baseline.select("notable_rate").scalar().alias("notable_rate"),
    )


def watch_hit(
    trends: DataFrame, trend_posts: DataFrame, keywords: tuple[str, ...], n_trends: int = 5, n_posts: int = 10
) -> DataFrame:
    """Whether a watched word is in a trend name or in the first posts of the first trends."""
    pattern = patterns.any_of(k.lower() for k in keywords)
    names = trends.select(F.lower("term").rlike(pattern).alias("hit"))
    sampled = (
        trend_posts.join(
            trends.where(F.col("rank") <= n_trends).select(F.col("term").alias("trend")),
            "trend",
            "left_semi",
        )
        .where(F.col("post_rank") <= n_posts)
        .select(F.lower("text").rlike(pattern).alias("hit"))
    )
    return names.unionByName(sampled).agg(F.coalesce(F.max("hit"), F.lit(False)).alias("watch_hit"))


def numbered_posts(trend_posts: DataFrame, length: int = 500) -> DataFrame:
    """Posts numbered within their trend; retweets take a number but are not shown."""
    order = Window.partitionBy("trend").orderBy(F.desc("created_at"), "id")
    return (
        trend_posts.withColumn("post_number", F.row_number().over(order))
        .where(~F.col("is_retweet"))
        .select(
            "trend",
            "post_number",
            "username",
            "likes",
            "retweets",
            F.substring("text", 1, length).alias("shown_text"),
        )
    )


def summary_row(
    run_date: dt.date,
    trends: DataFrame,
    trend_posts: DataFrame,
    news: DataFrame,
    baseline: float = 10000.0,
) -> DataFrame:
    """One row per run. ``trends`` is a ranked top-n list, so its names collect safely."""
    tenths = scoring.engagement_tenths(F.col("likes"), F.col("retweets"), F.col("replies"))
    named = trends.agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda t: t["term"]
        ).alias("trends")
    )
    posts = trend_posts.agg(
        F.count(F.lit(1)).alias("tweet_count"),
        F.coalesce(F.max(tenths) / 10.0, F.lit(0.0)).alias("top_engagement"),
    )
    articles = news.agg(F.count(F.lit(1)).alias("news_count"))
    row = one_row(named, posts, articles).withColumn("run_date", F.lit(run_date))
    return with_signal(row.withColumn("trend_count", F.size("trends")), baseline)
