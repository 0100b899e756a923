"""Engagement, trend scores, signal strength and timeline labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def engagement_tenths(likes: Column, retweets: Column, replies: Column) -> Column:
    """Engagement of a post in tenths: whole numbers add up the same in any order."""
    return (
        likes.cast("bigint") * 10 + retweets.cast("bigint") * 5 + replies.cast("bigint") * 3
    )


def engagement(likes: Column, retweets: Column, replies: Column) -> Column:
    """1.0 per like, 0.5 per retweet, 0.3 per reply."""
    return engagement_tenths(likes, retweets, replies) / 10.0


def ratio(part: Column, mentions: Column) -> Column:
    return part / F.greatest(mentions, F.lit(1))


def velocity_score(total_engagement: Column, authors: Column, mentions: Column) -> Column:
    """Engagement, raised up to threefold when many different authors post."""
    return total_engagement * (1 + ratio(authors, mentions) * 2)


def context_multiplier(context_ratio: Column) -> Column:
    return (
        F.when(context_ratio < 0.4, 0.01 + context_ratio * 0.5)
        .when(context_ratio < 0.7, 0.2 + context_ratio * 0.85)
        .otherwise(0.8 + context_ratio * 0.7)
    )


def composite_score(
    mentions: Column, velocity: Column, context_ratio: Column, cashtag_ratio: Column
) -> Column:
    base = mentions * 0.2 + velocity * 0.8
    return base * context_multiplier(context_ratio) * (1.0 + cashtag_ratio * 0.5)


def passes_quality(
    term_type: Column,
    authors: Column,
    context_ratio: Column,
    cashtag_ratio: Column,
    total_engagement: Column,
    min_authors: int = 10,
    min_context: float = 0.65,
    min_cashtag_ratio: float = 0.1,
    exceptional_context: float = 0.95,
    exceptional_engagement: float = 20000,
) -> Column:
    """Enough authors and context; words and hashtags also need company of cashtags."""
    exceptional = (context_ratio >= exceptional_context) & (
        total_engagement > exceptional_engagement
    )
    return (
        (authors >= min_authors)
        & (context_ratio >= min_context)
        & ((term_type == "cashtag") | (cashtag_ratio >= min_cashtag_ratio) | exceptional)
    )


def signal_strength(
    top_engagement: Column, trend_count: Column, baseline: Column | float = 10000.0
) -> Column:
    base = F.greatest(baseline if isinstance(baseline, Column) else F.lit(baseline), F.lit(1.0))
    times = top_engagement / base
    return (
        F.when(trend_count == 0, "none")
        .when((times > 5) & (trend_count >= 3), "high")
        .when((times > 2) | (trend_count >= 5), "medium")
        .when(times > 0.5, "low")
        .otherwise("none")
    )


def is_notable(signal: Column) -> Column:
    return signal == "high"


def is_new(appearances: Column) -> Column:
    return appearances == 1


def is_continuing(consecutive_days: Column) -> Column:
    return consecutive_days >= 2


def is_recurring(appearances: Column, gap: Column, gap_threshold: int = 14) -> Column:
    return (appearances != 1) & F.coalesce(gap >= gap_threshold, F.lit(False))


def temporal_badge(
    appearances: Column,
    consecutive_days: Column,
    gap: Column,
    consecutive_threshold: int = 3,
    gap_threshold: int = 14,
) -> Column:
    return (
        F.when(is_new(appearances), "New")
        .when(
            consecutive_days >= consecutive_threshold,
            F.concat(F.lit("Day "), consecutive_days.cast("string")),
        )
        .when(
            is_recurring(appearances, gap, gap_threshold) & (gap >= 180),
            F.concat(F.lit("Last seen "), F.floor(gap / 30).cast("string"), F.lit("mo ago")),
        )
        .when(
            is_recurring(appearances, gap, gap_threshold),
            F.concat(F.lit("Last seen "), gap.cast("string"), F.lit("d ago")),
        )
        .when(consecutive_days == 2, "Day 2")
        .otherwise("")
    )


def trajectory(mentions_today: Column, recent_mean: Column) -> Column:
    """Today's mentions against the mean of the last three appearances."""
    return (
        F.when(recent_mean.isNull(), "emerging")
        .when(mentions_today > recent_mean * 1.5, "accelerating")
        .when(mentions_today < recent_mean * 0.5, "declining")
        .otherwise("stable")
    )


def match_band(similarity: Column, strong: float = 0.75, moderate: float = 0.6) -> Column:
    return F.when(similarity > strong, "strong").when(similarity > moderate, "moderate")


def calendar_context(day: Column) -> Column:
    """Weekday name, weekend flag and early-quarter (reporting season) flag of a date."""
    return F.struct(
        F.date_format(day, "EEEE").alias("weekday_name"),
        (F.weekday(day) >= 5).alias("is_weekend"),
        (F.month(day).isin(1, 4, 7, 10) & (F.dayofmonth(day) <= 21)).alias("is_early_quarter"),
    )
