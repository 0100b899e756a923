"""Candidate ranking, deduplication, keep lists and phrase look-up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions import constants, text
from trendloom.functions.text import DEFAULT_RULES, TermRules
from trendloom.operators import mentions as m
from trendloom.operators.phrases import phrase_hits, phrase_key
from trendloom.session import broadcast_if, gathered, tasks_for


@dataclass(frozen=True)
class TrendLimits:
    """Support, size and quality parameters of trend discovery."""

    top_n: int = 10
    min_mentions: int = 3
    min_authors: int = 2
    quality_min_authors: int = 10
    quality_min_context: float = 0.65
    exact_authors: bool = True


DEFAULT_LIMITS = TrendLimits()


def type_order(term_type: Column) -> Column:
    return F.when(term_type == m.CASHTAG, 0).when(term_type == m.HASHTAG, 1).otherwise(2)


def keep_first(df: DataFrame, by: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order. The order must decide ties."""
    ranked = df.withColumn("_first", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where("_first = 1").drop("_first")


def best_first() -> list[Column]:
    return [F.desc("composite_score"), type_order(F.col("term_type")).asc(), F.asc("key")]


def by_norm(scored: DataFrame) -> DataFrame:
    """Trends with their normalized key, all spellings of a key in one task."""
    named = scored.withColumn("norm_key", text.normalized_key(F.col("term")))
    return gathered(named, tasks_for(scored), "norm_key")


def unique_trends(scored: DataFrame) -> DataFrame:
    """One trend per normalized key: the best-scored spelling."""
    return keep_first(by_norm(scored), ["norm_key"], best_first())


def candidates(
    posts: DataFrame, limits: TrendLimits = DEFAULT_LIMITS, rules: TermRules = DEFAULT_RULES
) -> DataFrame:
    """Top candidates over all three families, each with its quality flag and rank."""
    stats = m.post_stats(posts, m.ALL_TYPES, rules, limits.exact_authors, (limits.min_mentions, limits.min_authors))
    top = unique_trends(m.with_scores(stats)).orderBy(*best_first()).limit(limits.top_n)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*best_first())))
    return m.with_quality(ranked.drop("norm_key"), limits.quality_min_authors, limits.quality_min_context)


MAX_LISTED_KEYS = 2000


def with_samples(
    top: DataFrame, posts: DataFrame, rules: TermRules = DEFAULT_RULES, k: int = 3
) -> DataFrame:
    """Add sample texts to ranked candidates. ``top`` is a written top-n list: it is counted."""
    n = top.count()
    keys = top.select("term_type", "key")
    if 0 < n <= MAX_LISTED_KEYS:
        only: dict[str, list[str]] = {}
        for row in keys.collect():
            only.setdefault(row.term_type, []).append(row.key)
        chosen = m.mentions(posts, rules=rules, only=only)
    else:
        keys = broadcast_if(keys, n)
        chosen = m.mentions(posts, rules=rules).join(keys, ["term_type", "key"], "left_semi")
    samples = m.sample_texts(posts, chosen, k, n_terms=n)
    return top.join(samples, ["term_type", "key"], "left")


def top_terms(
    posts: DataFrame, limits: TrendLimits = DEFAULT_LIMITS, rules: TermRules = DEFAULT_RULES
) -> DataFrame:
    """Qualified candidates only, in rank order."""
    return candidates(posts, limits, rules).where("qualified").select("rank", "term")


def top_per_type(posts: DataFrame, top_n: int = 15, rules: TermRules = DEFAULT_RULES) -> DataFrame:
    """The best terms of each family without a support filter."""
    scored = m.with_scores(m.post_stats(posts, rules=rules))
    per_type = Window.partitionBy("term_type").orderBy(F.desc("composite_score"), "key")
    return scored.withColumn("type_rank", F.row_number().over(per_type)).where(
        F.col("type_rank") <= top_n
    )


def kept(top: DataFrame, keep_terms: DataFrame) -> DataFrame:
    """Candidates on the supplied keep list; unknown terms of the list drop out."""
    return top.join(keep_terms.select("term"), "term", "left_semi")


def rejected(top: DataFrame, keep_terms: DataFrame) -> DataFrame:
    return top.join(keep_terms.select("term"), "term", "left_anti")


def with_fallback(terms: DataFrame, fallback: tuple[str, ...] = constants.FALLBACK_TERMS) -> DataFrame:
    """The given terms, or the fallback terms when there are none."""
    spark = terms.sparkSession
    spare = spark.range(1).select(
        F.posexplode(F.array(*[F.lit(t) for t in fallback])).alias("pos", "term")
    )
    quiet = spare.where(~terms.exists())
    return terms.select("rank", "term").unionByName(
        quiet.select((F.col("pos") + 1).alias("rank"), "term")
    )


def topic_phrases(topics: DataFrame) -> DataFrame:
    """Topics written as 'a OR b OR c' as one row per alternative."""
    return topics.select("topic", F.explode(F.split("topic", " OR ")).alias("alternative")).select(
        "topic", phrase_key(F.col("alternative")).alias("phrase")
    )


def topic_matches(posts: DataFrame, topics: DataFrame) -> DataFrame:
    """Distinct (id, topic) pairs of posts that satisfy one alternative of a topic."""
    hits = phrase_hits(posts.select("id", "text"), topic_phrases(topics))
    return hits.select("id", "topic").distinct()


def trend_posts(posts: DataFrame, trends: DataFrame, limit_per_trend: int = 100) -> DataFrame:
    """The newest posts that mention each trend as a word, tag or phrase.

    Ids are matched and ranked first; only the posts within the limit fetch their text.
    ``posts`` has one row per id. ``trends`` is a written list: it is counted.
    """
    terms = trends.select(F.col("term").alias("trend"), phrase_key(F.col("term")).alias("phrase"))
    n = trends.count()
    hits = phrase_hits(posts.select("id", "created_at", "text"), terms, n)
    newest = Window.partitionBy("trend").orderBy(F.desc("created_at"), "id")
    chosen = (
        hits.withColumn("post_rank", F.row_number().over(newest))
        .where(F.col("post_rank") <= limit_per_trend)
        .select("trend", "id", "post_rank")
    )
    return posts.join(broadcast_if(chosen, n * limit_per_trend), "id")


def merged_trend_posts(collected: DataFrame, new: DataFrame) -> DataFrame:
    """Posts per trend after a resumed run: a trend collected again replaces its old posts."""
    untouched = collected.join(new.select("trend").distinct(), "trend", "left_anti")
    return untouched.unionByName(new)


def dedupe_posts(posts: DataFrame) -> DataFrame:
    """One row per post id: the one of the first topic in name order."""
    return keep_first(posts, ["id"], [F.asc("topic"), F.asc("created_at")])
