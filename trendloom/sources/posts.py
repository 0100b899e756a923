"""Post sources: raw posts, saved run states, per-topic selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom import schemas


def normalize_raw_posts(raw: DataFrame) -> DataFrame:
    """Raw posts to post rows: missing counts are 0, missing users 'unknown'."""
    known = F.col("user").isNotNull()
    return raw.select(
        "id",
        F.col("rawContent").alias("text"),
        F.when(known, F.col("user.username")).otherwise("unknown").alias("username"),
        F.when(known, F.col("user.displayname")).otherwise("Unknown").alias("display_name"),
        F.col("date").alias("created_at"),
        F.coalesce("likeCount", F.lit(0)).alias("likes"),
        F.coalesce("retweetCount", F.lit(0)).alias("retweets"),
        F.coalesce("replyCount", F.lit(0)).alias("replies"),
        F.col("viewCount").alias("views"),
        F.col("lang").alias("language"),
        F.coalesce(F.startswith("rawContent", F.lit("RT @")), F.lit(False)).alias("is_retweet"),
        F.coalesce("hashtags", F.array().cast("array<string>")).alias("hashtags"),
    )


def read_raw_posts(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return normalize_raw_posts(spark.read.schema(schemas.RAW_POST).format(fmt).load(path))


def read_run_states(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Saved run states: one JSON document per file, or one per line."""
    return spark.read.schema(schemas.RUN_STATE).json(path, multiLine=multi_line)


def state_posts(states: DataFrame) -> DataFrame:
    return states.select(F.explode("broad_tweets").alias("p")).select(*_state_post("p"))


def state_trend_posts(states: DataFrame) -> DataFrame:
    per_trend = states.select(F.explode("trend_tweets").alias("trend", "posts"))
    return per_trend.select("trend", F.explode("posts").alias("p")).select(
        "trend", *_state_post("p")
    )


def _state_post(name: str) -> list[Column]:
    fields = [
        "id", "text", "username", "display_name", "created_at", "likes", "retweets", "replies",
        "views", "language", "is_retweet", "hashtags",
    ]
    defaults = {
        "display_name": F.lit("Unknown"),
        "hashtags": F.array().cast("array<string>"),
    }
    return [
        F.coalesce(f"{name}.{f}", defaults[f]).alias(f) if f in defaults else F.col(f"{name}.{f}")
        for f in fields
    ]


def state_to_json(posts: DataFrame, trend_posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Post rows as JSON lines, the exchange form of a saved state at any size."""
    return (
        posts.select(F.to_json(F.struct(*posts.columns)).alias("value")),
        trend_posts.select(F.to_json(F.struct(*trend_posts.columns)).alias("value")),
    )


def select_per_topic(posts: DataFrame, limit_per_topic: int = 200, language: str = "en") -> DataFrame:
    """The newest posts of each topic in one language."""
    newest = Window.partitionBy("topic").orderBy(F.desc("created_at"), "id")
    return (
        posts.where(F.col("language") == language)
        .withColumn("topic_rank", F.row_number().over(newest))
        .where(F.col("topic_rank") <= limit_per_topic)
    )


def outstanding_topics(topics: DataFrame, ingest_status: DataFrame) -> DataFrame:
    """Topics not yet complete."""
    done = ingest_status.where("status <> 'retry'")
    return topics.join(done, "topic", "left_anti")


def outstanding_posts(posts: DataFrame, ingest_status: DataFrame) -> DataFrame:
    """Posts of topics whose collection is not yet complete."""
    return outstanding_topics(posts, ingest_status)
