"""Ingest status, run totals and run health."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.functions import health


def attempt_rows(topics: DataFrame, posts: DataFrame, run_date: dt.date, attempt: int) -> DataFrame:
    """Rows of the ingest log: how many posts an attempt brought for each topic, 0 included."""
    counts = posts.groupBy("topic").agg(F.count(F.lit(1)).alias("n_posts"))
    return topics.join(counts, "topic", "left").select(
        F.lit(run_date).alias("run_date"),
        "topic",
        F.lit(attempt).cast("bigint").alias("attempt"),
        F.coalesce("n_posts", F.lit(0)).alias("n_posts"),
    )


def ingest_status(ingest_log: DataFrame, max_retries: int = 3) -> DataFrame:
    """Per run day and topic: complete after any non-empty attempt or too many empty ones."""
    counted = ingest_log.groupBy("run_date", "topic").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("n_posts") == 0).alias("empty_attempts"),
        F.sum("n_posts").alias("n_posts"),
    )
    return counted.withColumn(
        "status",
        F.when(F.col("n_posts") > 0, "complete")
        .when(F.col("empty_attempts") > max_retries, "complete_empty")
        .otherwise("retry"),
    )


def one_row(*parts: DataFrame) -> DataFrame:
    """Single-row results side by side: a union of their columns, folded into one row."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def run_totals(
    posts: DataFrame, trend_posts: DataFrame, status: DataFrame, news: DataFrame
) -> DataFrame:
    """One row of counters over all steps of a run."""
    broad = posts.agg(F.count(F.lit(1)).alias("broad_posts"))
    deep = trend_posts.agg(
        F.count(F.lit(1)).alias("deep_dive_posts"),
        F.countDistinct("trend").alias("deep_dive_trends"),
    )
    sources = status.agg(
        F.count(F.lit(1)).alias("topics_attempted"),
        F.count_if(F.col("status") != "retry").alias("topics_completed"),
        F.count_if(F.col("status") == "complete").alias("sources_active"),
    )
    articles = news.agg(F.count(F.lit(1)).alias("news_articles"))
    row = one_row(broad, deep, sources, articles)
    return row.withColumn("total_posts", F.col("broad_posts") + F.col("deep_dive_posts"))


def run_health(run_metrics: DataFrame) -> DataFrame:
    """Duration, error and warning flags, and the alert decision of every run."""
    posts = F.col("broad_posts") + F.col("deep_dive_posts")
    active, total = F.col("sources_active"), F.col("sources_total")
    trends, errors, warnings = F.col("trends_discovered"), F.col("errors"), F.col("warnings")
    sent = F.col("report_sent")
    seconds = health.duration_seconds(F.col("start_time"), F.col("end_time"))
    return run_metrics.select(
        "run_id",
        posts.alias("total_posts"),
        seconds.alias("duration_seconds"),
        health.duration_label(seconds).alias("duration"),
        health.has_critical_errors(posts, active, total, errors, sent).alias("critical"),
        health.has_warnings(posts, trends, active, total, warnings).alias("has_warnings"),
        health.alert(posts, trends, active, total, errors, warnings, sent).alias("a"),
    ).select("*", "a.*").drop("a")
