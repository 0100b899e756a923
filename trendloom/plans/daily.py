"""One daily run: discover, deep-dive, compare with history, check claims, store."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom import schemas
from trendloom.functions import digest_text, text
from trendloom.functions.text import DEFAULT_RULES, TermRules
from trendloom.operators import digests, health, market, memory, news, ranking, timeline
from trendloom.operators.ranking import DEFAULT_LIMITS, TrendLimits
from trendloom.session import folder_exists, written
from trendloom.sources.posts import outstanding_topics, select_per_topic
from trendloom.sources import tables


@dataclass(frozen=True)
class Run:
    """Results of a run. Each is a table or a plan over written tables."""

    candidates: DataFrame
    rejected: DataFrame
    trend_posts: DataFrame
    timelines: DataFrame
    quotes: DataFrame
    claims: DataFrame
    news: DataFrame
    summary: DataFrame


def run_day(
    posts: DataFrame,
    history: DataFrame,
    bars: DataFrame,
    news_rows: DataFrame,
    as_of: dt.date,
    keep_terms: DataFrame | None = None,
    limits: TrendLimits = DEFAULT_LIMITS,
    rules: TermRules = DEFAULT_RULES,
    posts_per_trend: int = 100,
    baseline_engagement: float = 10000.0,
) -> Run:
    """Everything a day's report needs, from a day's posts.

    ``posts`` has one row per id. The two results that many others build on, the candidates and
    their posts, are written once; both are bounded by ``top_n`` and ``posts_per_trend``.
    """
    top = written(ranking.candidates(posts, limits, rules), "candidates")
    qualified = top.where("qualified")
    if keep_terms is None:
        rejected = top.where("NOT qualified")
    else:
        rejected = ranking.rejected(qualified, keep_terms)
        qualified = ranking.kept(qualified, keep_terms)
    terms = ranking.with_fallback(qualified.select("rank", "term"))
    deep = written(ranking.trend_posts(posts, terms, posts_per_trend), "deep-dive")
    lines = timeline.timelines(timeline.run_details(deep), history, as_of)
    quotes = written(market.quotes(bars, as_of), "quotes")
    wanted = market.with_common_symbols(market.requested_symbols(terms))
    articles = news.fetch_news(news_rows)
    return Run(
        candidates=ranking.with_samples(top, posts, rules),
        rejected=rejected,
        trend_posts=deep,
        timelines=lines,
        quotes=market.with_flags(quotes.join(wanted, "symbol", "left_semi")),
        claims=market.checked_claims(market.claims(deep.dropDuplicates(["id"])), quotes),
        news=articles,
        summary=digests.summary_row(as_of, terms, deep, articles, baseline_engagement),
    )


def activity_rows(run: Run, as_of: dt.date) -> DataFrame:
    """Today's rows of trend_history, under the key by which they will be looked up."""
    rows = run.timelines.groupBy(text.normalized_key(F.col("term")).alias("trend_term")).agg(
        F.sum("mentions_today").cast("int").alias("mention_count"),
        F.sum("engagement_today").alias("engagement_score"),
    )
    return rows.withColumn("run_date", F.lit(as_of))


def store_day(run: Run, folder: str, as_of: dt.date, digest_text: str, now: dt.datetime) -> None:
    """Append the run's summary and digest, upsert the trend history and the memory of the day."""
    summary = run.summary.withColumn("created_at", F.lit(now).cast("timestamp_ntz"))
    summary.coalesce(1).write.mode("append").parquet(f"{folder}/summaries")  # one row
    row = run.summary.select(
        "run_date",
        "trends",
        F.col("tweet_count").cast("int").alias("tweet_count"),
        F.lit(digest_text).alias("digest_text"),
        "signal_strength",
        "top_engagement",
        "notable",
        F.lit(now).cast("timestamp_ntz").alias("created_at"),
    )
    row = written(row, "digest")
    tables.store_digests(row, f"{folder}/digests")
    tables.store_trend_history(activity_rows(run, as_of), f"{folder}/trend_history")
    record = memory.memory_records(row).withColumn("created_at", F.lit(now).cast("timestamp_ntz"))
    tables.store_memories(record, f"{folder}/memories")


def stored_history(spark: SparkSession, folder: str) -> DataFrame:
    """The trend history, empty before the first run."""
    try:
        return tables.read_trend_history(spark, f"{folder}/trend_history")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schemas.TREND_HISTORY)


def parallels(spark: SparkSession, folder: str, as_of: dt.date, k: int = 5, min_similarity: float = 0.6) -> DataFrame:
    """Past days most similar to the conditions of as_of, strong ones first, three at most.

    The conditions are the trends, themes, sentiment and signal of the day's memory, as a query text
    of their own; only earlier days are searched. Word weights are those of the whole history.
    """
    memories = tables.read_memories(spark, f"{folder}/memories")
    model = memory.embedder(memories.select("embedding_text"), "embedding_text")
    day = tables.read_memories(spark, f"{folder}/memories", f"memory_{as_of:%Y%m%d}")
    conditions = digest_text.query_text(F.col("trends"), F.col("themes"), F.col("sentiment"), F.col("signal_strength"))
    asked = memory.embedded(day.select("id", conditions.alias("embedding_text")), model)
    asked = asked.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    past = memories.where(F.to_date("date") < F.lit(as_of))
    hits = memory.search(memory.embedded(past, model), asked, k, min_similarity)
    return memory.parallels_within_budget(hits, moderate=min_similarity)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the store, empty before its first row."""
    if not folder_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def collect_topics(
    posts: DataFrame,
    topics: DataFrame,
    ingest_log: DataFrame,
    as_of: dt.date,
    limit_per_topic: int = 200,
    language: str = "en",
) -> tuple[DataFrame, DataFrame]:
    """The posts of a run by topic, and the attempts to be added to the ingest log.

    Topics that are complete for the day are skipped. The newest posts of a language that match a
    topic are taken, and a post of several topics counts once.
    """
    today = ingest_log.where(F.col("run_date") == F.lit(as_of))
    open_topics = outstanding_topics(topics, health.ingest_status(today))
    matched = posts.drop("topic").join(ranking.topic_matches(posts, open_topics), "id")
    taken = written(select_per_topic(matched, limit_per_topic, language).drop("topic_rank"), "topic-posts")
    number = today.agg(F.coalesce(F.max("attempt"), F.lit(0)) + 1).first()[0]
    return ranking.dedupe_posts(taken), health.attempt_rows(open_topics, taken, as_of, number)


def run_metrics(
    run: Run, posts: DataFrame, attempts: DataFrame, run_id: int, start: dt.datetime, end: dt.datetime,
    errors: tuple[str, ...] = (), warnings: tuple[str, ...] = (), report_sent: bool = True,
) -> DataFrame:
    """The run's row of run_metrics, from which `health.run_health` decides on alerts."""
    totals = health.run_totals(posts, run.trend_posts, health.ingest_status(attempts), run.news)
    found = run.candidates.agg(F.count(F.lit(1)).alias("trends_discovered"))
    texts = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    return health.one_row(totals, found).select(
        F.lit(run_id).cast("bigint").alias("run_id"),
        F.lit(start).cast("timestamp_ntz").alias("start_time"),
        F.lit(end).cast("timestamp_ntz").alias("end_time"),
        "broad_posts",
        "deep_dive_posts",
        "trends_discovered",
        "sources_active",
        F.col("topics_attempted").alias("sources_total"),
        F.lit(report_sent).alias("report_sent"),
        texts(errors).alias("errors"),
        texts(warnings).alias("warnings"),
    )


def store_log(metrics: DataFrame, attempts: DataFrame, folder: str) -> None:
    """Append the run's metrics (one row) and its attempts (one row per topic)."""
    metrics.coalesce(1).write.mode("append").parquet(f"{folder}/run_metrics")
    attempts.write.mode("append").parquet(f"{folder}/ingest_log")
