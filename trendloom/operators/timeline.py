"""Trend history joins: streaks, gaps, trajectories and temporal classes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions import scoring, text

LOOKBACK_DAYS = 180


def in_days(column: str, as_of: dt.date, days: int) -> Column:
    """The days from as_of - days to as_of, both included; a literal range, so partitions are pruned."""
    return F.col(column).between(F.lit(as_of - dt.timedelta(days=days)), F.lit(as_of))


def daily_rows(history: DataFrame) -> DataFrame:
    """One row per normalized key and day: figures of several spellings of a term are added."""
    cents = F.round(F.col("engagement_score") * 100).cast("bigint")
    return history.groupBy(text.normalized_key(F.col("trend_term")).alias("term_normalized"), "run_date").agg(
        F.sum("mention_count").alias("mentions"),
        F.when(F.count("*") == 1, F.max("engagement_score")).otherwise(F.sum(cents) / 100.0).alias("engagement"),
    )


def history_window(history: DataFrame, as_of: dt.date, days: int = LOOKBACK_DAYS) -> DataFrame:
    """Daily rows in [as_of - days, as_of)."""
    return daily_rows(history.where(in_days("run_date", as_of, days) & (F.col("run_date") < F.lit(as_of))))


def run_details(trend_posts: DataFrame) -> DataFrame:
    """Today's figures per trend: mentions count retweets, engagement does not."""
    tenths = scoring.engagement_tenths(F.col("likes"), F.col("retweets"), F.col("replies"))
    return trend_posts.groupBy("trend").agg(
        F.count(F.lit(1)).cast("int").alias("mentions"),
        (F.coalesce(F.sum(F.when(~F.col("is_retweet"), tenths)), F.lit(0)) / 10.0).alias(
            "engagement"
        ),
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
    )


def top_engagement(trend_posts: DataFrame) -> DataFrame:
    """Highest engagement of a single post, retweets included, 0 when there are none."""
    tenths = scoring.engagement_tenths(F.col("likes"), F.col("retweets"), F.col("replies"))
    return trend_posts.agg(F.coalesce(F.max(tenths) / 10.0, F.lit(0.0)).alias("top_engagement"))


def past_profile(window_rows: DataFrame, as_of: dt.date, recent: int = 7) -> DataFrame:
    """Per key: appearances, last date, streak of days before as_of, and recent figures.

    ``window_rows`` holds one row per key and day (`daily_rows`), so a key has at most as many rows
    as the look-back has days, and one aggregation computes everything without a sort of the table.
    """
    today = F.lit(as_of)
    days = F.sort_array(
        F.collect_list(F.struct("run_date", "mentions", "engagement")), asc=False
    )
    # Newest first, the i-th day belongs to the streak exactly if it is i+1 days before today.
    streak = F.size(
        F.filter(
            F.transform(
                F.col("days"),
                lambda d, i: F.date_add(d["run_date"], i + 1) == today,
            ),
            lambda same: same,
        )
    )
    return (
        window_rows.groupBy("term_normalized")
        .agg(days.alias("days"))
        .select(
            "term_normalized",
            F.size("days").alias("past_appearances"),
            streak.alias("streak"),
            F.col("days")[0]["run_date"].alias("last_seen_date"),
            F.slice(F.col("days.mentions"), 1, recent).alias("previous_mentions"),
            F.slice(F.col("days.engagement"), 1, recent).alias("previous_engagements"),
        )
    )


def timelines(
    today: DataFrame,
    history: DataFrame,
    as_of: dt.date,
    days: int = LOOKBACK_DAYS,
    consecutive_threshold: int = 3,
    gap_threshold: int = 14,
) -> DataFrame:
    """Timeline of every trend of today (columns of ``run_details``) against its history."""
    current = today.withColumn("term_normalized", text.normalized_key(F.col("trend")))
    relevant = history_window(history, as_of, days).join(
        current.select("term_normalized").distinct(), "term_normalized", "left_semi"
    )
    joined = current.join(past_profile(relevant, as_of), "term_normalized", "left")
    empty_counts, empty_scores = F.array().cast("array<bigint>"), F.array().cast("array<double>")
    rows = joined.select(
        F.col("trend").alias("term"),
        "term_normalized",
        F.col("first_seen").alias("first_seen_today"),
        F.col("last_seen").alias("last_seen_today"),
        F.col("mentions").alias("mentions_today"),
        F.col("engagement").alias("engagement_today"),
        F.coalesce(F.col("streak") + 1, F.lit(0)).alias("consecutive_days"),
        (F.coalesce("past_appearances", F.lit(0)) + 1).alias("total_appearances"),
        "last_seen_date",
        F.datediff(F.lit(as_of), "last_seen_date").alias("days_since_last"),
        F.coalesce("previous_mentions", empty_counts).alias("previous_mentions"),
        F.coalesce("previous_engagements", empty_scores).alias("previous_engagements"),
    )
    return with_labels(rows, consecutive_threshold, gap_threshold)


def timeline_of(timeline_rows: DataFrame, term: str) -> DataFrame:
    """The timeline of one trend, by any spelling of its name."""
    return timeline_rows.where(
        F.col("term_normalized") == text.normalized_key(F.lit(term))
    )


def recent_mean(previous: Column, n: int = 3) -> Column:
    """Mean of the newest n counts, null when there are none."""
    newest = F.slice(previous, 1, n)
    total = F.aggregate(newest, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return F.when(F.size(newest) > 0, total / F.size(newest))


def with_labels(
    rows: DataFrame, consecutive_threshold: int = 3, gap_threshold: int = 14
) -> DataFrame:
    appearances, days = F.col("total_appearances"), F.col("consecutive_days")
    gap = F.col("days_since_last")
    return (
        rows.withColumn("is_new", scoring.is_new(appearances))
        .withColumn("is_continuing", scoring.is_continuing(days))
        .withColumn("is_recurring", scoring.is_recurring(appearances, gap, gap_threshold))
        .withColumn(
            "badge",
            scoring.temporal_badge(appearances, days, gap, consecutive_threshold, gap_threshold),
        )
        .withColumn(
            "trajectory",
            scoring.trajectory(F.col("mentions_today"), recent_mean(F.col("previous_mentions"))),
        )
    )


def class_counts(timeline_rows: DataFrame) -> DataFrame:
    """How many trends are new, else continuing, else recurring; and how many are any of them."""
    new, cont, rec = F.col("is_new"), F.col("is_continuing"), F.col("is_recurring")
    return timeline_rows.agg(
        F.count_if(new).alias("new_trends"),
        F.count_if(~new & cont).alias("continuing_trends"),
        F.count_if(~new & ~cont & rec).alias("recurring_trends"),
        F.count_if(new | cont | rec).alias("temporal_patterns"),
    )


def context_order(timeline_rows: DataFrame) -> DataFrame:
    """Multi-day trends by length, then recurring trends by gap: one row per listed class."""
    entry = F.struct
    classes = F.array_compact(
        F.array(
            F.when(
                F.col("is_continuing"),
                entry(
                    F.lit("continuing").alias("temporal_class"),
                    F.lit(0).alias("class_order"),
                    F.col("consecutive_days").alias("weight"),
                ),
            ),
            F.when(
                F.col("is_recurring"),
                entry(
                    F.lit("recurring").alias("temporal_class"),
                    F.lit(1).alias("class_order"),
                    F.col("days_since_last").alias("weight"),
                ),
            ),
        )
    )
    listed = timeline_rows.select("term", F.explode(classes).alias("c")).select("term", "c.*")
    return listed.orderBy("class_order", F.desc("weight"), "term")


def trend_history(history: DataFrame, term: str, as_of: dt.date, days: int = 30) -> DataFrame:
    """One trend's daily figures of the last days, by any spelling of its name, newest first."""
    same = text.normalized_key(F.col("trend_term")) == text.normalized_key(F.lit(term))
    rows = daily_rows(history.where(in_days("run_date", as_of, days) & same))
    return rows.select(
        "run_date", F.col("mentions").alias("mention_count"), F.col("engagement").alias("engagement_score")
    ).orderBy(F.desc("run_date"))


def recent_trends(history: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    """Every trend (by normalized key) of the last days with its daily figures, newest first."""
    entry = F.struct("run_date", F.col("mentions").alias("mention_count"), F.col("engagement").alias("engagement_score"))
    return (
        daily_rows(history.where(in_days("run_date", as_of, days)))
        .groupBy(F.col("term_normalized").alias("trend_term"))
        .agg(F.sort_array(F.collect_list(entry), asc=False).alias("days"))
    )


def streaks(history: DataFrame) -> DataFrame:
    """Every unbroken run of days of every trend, by normalized key.

    A key has one row per day, which bounds its window; daily rows, not mentions, are sorted here.
    """
    by_day = Window.partitionBy("term_normalized").orderBy("run_date")
    island = F.date_sub(F.col("run_date"), F.row_number().over(by_day))
    return (
        daily_rows(history)
        .withColumn("island", island)
        .groupBy(F.col("term_normalized").alias("trend_term"), "island")
        .agg(
            F.min("run_date").alias("first_day"),
            F.max("run_date").alias("last_day"),
            F.count(F.lit(1)).alias("n_days"),
            F.sum("mentions").alias("mentions"),
        )
        .drop("island")
    )


def appearance_gaps(history: DataFrame) -> DataFrame:
    """Gap to the previous appearance, appearances so far, and mean of the last three daily counts."""
    by_day = Window.partitionBy("term_normalized").orderBy("run_date")
    return daily_rows(history).select(
        F.col("term_normalized").alias("trend_term"),
        "run_date",
        F.col("mentions").alias("mention_count"),
        F.datediff("run_date", F.lag("run_date").over(by_day)).alias("gap_days"),
        F.row_number().over(by_day).alias("appearances"),
        F.avg("mentions").over(by_day.rowsBetween(-3, -1)).alias("recent_mean"),
    )


def digest_badges(digests: DataFrame, timeline_rows: DataFrame) -> DataFrame:
    """Trend names of each digest with their badges, in digest order.

    A digest lists at most top_n trends, so the collected lists are short.
    """
    listed = digests.select("run_date", F.posexplode("trends").alias("pos", "term"))
    badged = listed.join(timeline_rows.select("term", "badge"), "term", "left").select(
        "run_date", "pos", "term", F.coalesce("badge", F.lit("")).alias("badge")
    )
    return badged.groupBy("run_date").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("pos", "term", "badge"))),
            lambda t: F.when(t["badge"] == "", t["term"]).otherwise(
                F.concat(t["term"], F.lit(" ["), t["badge"], F.lit("]"))
            ),
        ).alias("trend_labels")
    )
