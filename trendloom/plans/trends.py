"""Queries over trends: statistics, scores, ranking, deep dive."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from trendloom.functions import constants, patterns, text
from trendloom.operators import authors, digests, mentions, ranking, timeline
from trendloom.plans import oracle as o
from trendloom.plans import testdata as td
from trendloom.plans.registry import query
from trendloom.session import gathered, tasks_for, work_folder, written

STATS = (
    "term_type", "key", "mention_count", "unique_authors", "total_engagement", "avg_engagement",
    "first_seen", "last_seen", "financial_context_count", "cashtag_cooccurrence_count",
)
_STATS = ", ".join(STATS)


def _posts(spark, sf):
    return td.derived(spark, sf, "posts")


@query(
    "cashtag_trends",
    o.with_ctes(["cashtag_mentions"], f"SELECT {_STATS} FROM ({o.stats_sql('cashtag_mentions')}) s"),
)
def _(spark, sf):
    return mentions.post_stats(_posts(spark, sf), (mentions.CASHTAG,)).select(*STATS)


@query(
    "hashtag_trends",
    o.with_ctes(["hashtag_mentions"], f"SELECT {_STATS} FROM ({o.stats_sql('hashtag_mentions')}) s"),
)
def _(spark, sf):
    return mentions.post_stats(_posts(spark, sf), (mentions.HASHTAG,)).select(*STATS)


@query(
    "ngram_trends",
    o.with_ctes(
        ["ngram_mentions"],
        f"""SELECT {_STATS} FROM ({o.stats_sql('ngram_mentions')}) s
            WHERE mention_count >= 3 AND unique_authors >= 2""",
    ),
)
def _(spark, sf):
    return mentions.supported_post_stats(_posts(spark, sf), (mentions.NGRAM,)).select(*STATS)


@query(
    "term_authors",
    o.with_ctes(
        ["mentions"],
        "SELECT term_type, key, count(DISTINCT username) AS authors FROM mentions GROUP BY 1, 2",
    ),
)
def _(spark, sf):
    rows = mentions.mentions(_posts(spark, sf)).select("term_type", "key", "username")
    rows = gathered(rows, tasks_for(rows), "term_type", "key")
    return rows.groupBy("term_type", "key").agg(F.countDistinct("username").alias("authors"))


@query(
    "term_authors_over_days",
    o.with_ctes(
        ["cashtag_mentions", "hashtag_mentions"],
        f"""SELECT {o.norm('key')} AS trend_term, count(DISTINCT CAST(created_at AS DATE)) AS active_days, count(DISTINCT username) AS authors
            FROM (SELECT key, created_at, username FROM cashtag_mentions UNION ALL SELECT key, created_at, username FROM hashtag_mentions) t
            WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-20' - 13 AND DATE '2024-01-20' GROUP BY 1""",
    ),
)
def _(spark, sf):
    """Authors of tags over two weeks, from stored sketches; so few authors are counted exactly."""
    path = work_folder(spark, "author-sketches")
    tags = mentions.mentions(_posts(spark, sf), (mentions.CASHTAG, mentions.HASHTAG))
    authors.store_sketches(authors.daily_sketches(tags), path)
    first = td.AS_OF - dt.timedelta(days=13)
    return authors.authors_between(authors.read_sketches(spark, path), first, td.AS_OF)


@query(
    "term_first_posts",
    o.with_ctes(
        ["mentions", "posts"],
        """SELECT term_type, key, CAST(rk AS INT) AS sample_rank, m.id, substring(p.text, 1, 200) AS sample FROM (
             SELECT *, row_number() OVER (PARTITION BY term_type, key ORDER BY created_at, id) AS rk
             FROM mentions) m JOIN posts p USING (id) WHERE rk <= 3""",
    ),
)
def _(spark, sf):
    return mentions.first_post_samples(_posts(spark, sf))


_SCORES = (
    "term, term_type, key, financial_context_ratio, cashtag_cooccurrence_ratio, "
    "velocity_score, composite_score"
)


@query("trend_scores", o.with_ctes(["scored"], f"SELECT {_SCORES} FROM scored"))
def _(spark, sf):
    stats = mentions.supported_post_stats(_posts(spark, sf))
    return mentions.with_scores(stats).select(
        "term", "term_type", "key", "financial_context_ratio", "cashtag_cooccurrence_ratio",
        "velocity_score", "composite_score",
    )


@query(
    "trend_quality",
    o.with_ctes(["scored"], f"SELECT term_type, key, {o.QUALITY} AS qualified FROM scored"),
)
def _(spark, sf):
    stats = mentions.supported_post_stats(_posts(spark, sf))
    return mentions.with_quality(mentions.with_scores(stats)).select("term_type", "key", "qualified")


@query(
    "trend_families",
    o.with_ctes(
        ["stats"],
        """SELECT term_type, count(*) AS terms, CAST(sum(mention_count) AS BIGINT) AS mentions,
             count(*) FILTER (mention_count >= 3 AND unique_authors >= 2) AS supported FROM stats GROUP BY 1""",
    ),
)
def _(spark, sf):
    stats = mentions.post_stats(_posts(spark, sf))
    support = (F.col("mention_count") >= 3) & (F.col("unique_authors") >= 2)
    return stats.groupBy("term_type").agg(
        F.count(F.lit(1)).alias("terms"),
        F.sum("mention_count").alias("mentions"),
        F.count_if(support).alias("supported"),
    )


@query(
    "unique_trends",
    o.with_ctes(["unique_trends"], f"SELECT term_type, key, {o.norm('term')} AS norm_key FROM unique_trends"),
)
def _(spark, sf):
    stats = mentions.supported_post_stats(_posts(spark, sf))
    kept = ranking.unique_trends(mentions.with_scores(stats))
    return kept.select("term_type", "key", "norm_key")


_CANDIDATE = "rank, term, term_type, mention_count, unique_authors, total_engagement, composite_score, qualified"


def top_candidates(spark, sf):
    return ranking.candidates(_posts(spark, sf)).select(
        F.col("rank").cast("bigint").alias("rank"), "term", "term_type", "mention_count",
        "unique_authors", "total_engagement",
        "composite_score", "qualified",
    )


query("top_candidates", o.with_ctes(["candidates"], f"SELECT {_CANDIDATE} FROM candidates"))(top_candidates)


@query(
    "qualified_terms",
    o.with_ctes(["candidates"], "SELECT CAST(rank AS INT) AS rank, term FROM candidates WHERE qualified"),
)
def _(spark, sf):
    return ranking.top_terms(_posts(spark, sf))


@query(
    "top_terms_per_type",
    o.with_ctes(
        ["stats"],
        """SELECT term_type, key, CAST(rk AS INT) AS type_rank, composite_score FROM (
             SELECT *, row_number() OVER (PARTITION BY term_type ORDER BY composite_score DESC, key) AS rk
             FROM all_scored) r WHERE rk <= 15""",
        all_scored=o.scored_sql("stats"),
    ),
)
def _(spark, sf):
    return ranking.top_per_type(_posts(spark, sf)).select(
        "term_type", "key", "type_rank", "composite_score"
    )


@query(
    "candidate_samples",
    o.with_ctes(
        ["candidates", "mentions", "posts"],
        """SELECT c.term, count(*) AS n_samples, md5(string_agg(substring(p.text, 1, 200), '|' ORDER BY rk)) AS samples_md5
           FROM candidates c JOIN (
             SELECT *, row_number() OVER (PARTITION BY term_type, key ORDER BY created_at, id) AS rk FROM mentions) m
             USING (term_type, key) JOIN posts p ON p.id = m.id WHERE rk <= 3 GROUP BY 1""",
    ),
)
def _(spark, sf):
    posts = _posts(spark, sf)
    top = written(ranking.candidates(posts), "candidates")
    return ranking.with_samples(top, posts).select(
        "term",
        F.size("sample_tweets").cast("bigint").alias("n_samples"),
        F.md5(F.array_join("sample_tweets", "|")).alias("samples_md5"),
    )


def _keep_terms(spark, sf):
    """A keep list for the queries below: terms supported by English posts alone."""
    english = _posts(spark, sf).where("language = 'en'")
    return mentions.with_scores(mentions.supported_post_stats(english))


_TOP_40 = ranking.TrendLimits(top_n=40)
_KEEP_SQL = {
    "top_40": f"SELECT * FROM unique_trends ORDER BY {o.BEST} LIMIT 40",
    "keep_terms": f"""SELECT DISTINCT {o.display('term_type', 'key')} AS term FROM (
        SELECT term_type, key FROM mentions JOIN posts USING (id) WHERE language = 'en'
        GROUP BY term_type, key HAVING count(*) >= 3 AND count(DISTINCT mentions.username) >= 2) k""",
}


@query(
    "kept_candidates",
    o.with_ctes(
        ["unique_trends", "mentions", "posts"],
        "SELECT term, term_type FROM top_40 WHERE term IN (SELECT term FROM keep_terms)",
        **_KEEP_SQL,
    ),
)
def _(spark, sf):
    top = ranking.candidates(_posts(spark, sf), _TOP_40)
    return ranking.kept(top, _keep_terms(spark, sf)).select("term", "term_type")


@query(
    "rejected_candidates",
    o.with_ctes(
        ["unique_trends", "mentions", "posts"],
        "SELECT term, term_type FROM top_40 WHERE term NOT IN (SELECT term FROM keep_terms)",
        **_KEEP_SQL,
    ),
)
def _(spark, sf):
    top = ranking.candidates(_posts(spark, sf), _TOP_40)
    return ranking.rejected(top, _keep_terms(spark, sf)).select("term", "term_type")


@query(
    "terms_or_fallback",
    o.with_ctes(
        ["candidates"],
        f"""SELECT CAST(rank AS INT) AS rank, term FROM found
            UNION ALL SELECT CAST(i AS INT), [{o.quoted(constants.FALLBACK_TERMS)}][i] FROM range(1, 4) r(i)
            WHERE NOT EXISTS (SELECT 1 FROM found)""",
        found="SELECT rank, term FROM candidates WHERE qualified AND unique_authors >= 1000000",
    ),
)
def _(spark, sf):
    strict = ranking.TrendLimits(quality_min_authors=1_000_000)
    return ranking.with_fallback(written(ranking.top_terms(_posts(spark, sf), strict), "terms"))


_PLAIN = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '(^|[^\p{{L}}\p{{N}}_])''+', '\1 ', 'g'), '''+([^\p{{L}}\p{{N}}_]|$)', ' \1', 'g'), '[^\p{{L}}\p{{N}}_$#''%&]+', ' ', 'g'), ' ')"""
_DEEP_SQL = {
    "hits": f"""SELECT c.term AS trend, p.* FROM candidates c JOIN
        (SELECT *, concat(' ', {_PLAIN.format(x='text')}, ' ') AS t FROM posts) p
        ON contains(p.t, concat(' ', {_PLAIN.format(x='c.term')}, ' '))""",
    "deep": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trend ORDER BY created_at DESC, id) AS post_rank
        FROM hits) r WHERE post_rank <= 100""",
}


def deep_dive(spark, sf):
    """Posts of the top candidates of a run."""
    posts = _posts(spark, sf)
    top = written(ranking.candidates(posts).select("rank", "term"), "candidates")
    return top, ranking.trend_posts(posts, top)


@query(
    "trend_posts",
    o.with_ctes(
        ["candidates", "posts"], "SELECT trend, id, CAST(post_rank AS INT) AS post_rank FROM deep", **_DEEP_SQL
    ),
)
def _(spark, sf):
    return deep_dive(spark, sf)[1].select("trend", "id", "post_rank")


@query(
    "merged_trend_posts",
    o.with_ctes(
        ["candidates", "posts"],
        """SELECT trend, id, source FROM collected WHERE trend NOT IN (SELECT trend FROM fresh)
           UNION ALL SELECT trend, id, source FROM fresh""",
        **_DEEP_SQL,
        collected="SELECT trend, id, 'collected' AS source FROM deep WHERE language = 'en'",
        fresh="SELECT trend, id, 'new' AS source FROM deep WHERE language = 'fr'",
    ),
)
def _(spark, sf):
    deep = written(deep_dive(spark, sf)[1].select("trend", "id", "language"), "deep-dive")
    collected = deep.where("language = 'en'").withColumn("source", F.lit("collected"))
    new = deep.where("language = 'fr'").withColumn("source", F.lit("new"))
    return ranking.merged_trend_posts(collected, new).select("trend", "id", "source")


@query(
    "run_details",
    o.with_ctes(
        ["candidates", "posts"],
        f"""SELECT trend, CAST(count(*) AS INT) AS mentions,
              coalesce(sum({o.tenths()}) FILTER (NOT is_retweet), 0) / 10.0 AS engagement,
              min(created_at) AS first_seen, max(created_at) AS last_seen FROM deep GROUP BY trend""",
        **_DEEP_SQL,
    ),
)
def _(spark, sf):
    return timeline.run_details(deep_dive(spark, sf)[1])


@query(
    "top_engagement",
    o.with_ctes(
        ["candidates", "posts"],
        f"SELECT coalesce(max({o.tenths()}) / 10.0, 0) AS top_engagement FROM deep",
        **_DEEP_SQL,
    ),
)
def _(spark, sf):
    return timeline.top_engagement(deep_dive(spark, sf)[1])


@query(
    "numbered_posts",
    o.with_ctes(
        ["candidates", "posts"],
        """SELECT trend, CAST(n AS INT) AS post_number, username, likes, retweets, substring(text, 1, 500) AS shown_text
           FROM (SELECT *, row_number() OVER (PARTITION BY trend ORDER BY created_at DESC, id) AS n FROM deep) d
           WHERE NOT is_retweet""",
        **_DEEP_SQL,
    ),
)
def _(spark, sf):
    return digests.numbered_posts(deep_dive(spark, sf)[1])


WATCHED = ("shortage", "layoffs", "premarket")


@query(
    "watch_hit",
    o.with_ctes(
        ["candidates", "posts"],
        f"""SELECT coalesce(bool_or(hit), false) AS watch_hit FROM (
              SELECT regexp_matches(lower(term), '{o.flat(WATCHED)}') AS hit FROM candidates
              UNION ALL SELECT regexp_matches(lower(text), '{o.flat(WATCHED)}') FROM deep
              WHERE post_rank <= 10 AND trend IN (SELECT term FROM candidates WHERE rank <= 5)) h""",
        **_DEEP_SQL,
    ),
)
def _(spark, sf):
    top, posts = deep_dive(spark, sf)
    return digests.watch_hit(top, posts, WATCHED)


@query(
    "watched_posts",
    o.with_ctes(
        ["posts"],
        f"""SELECT topic, count(*) AS n_posts, count(*) FILTER (regexp_matches(lower(text), '{o.flat(WATCHED)}')) AS n_watched
            FROM posts GROUP BY topic""",
    ),
)
def _(spark, sf):
    hit = F.lower("text").rlike(patterns.any_of(WATCHED))
    return _posts(spark, sf).groupBy("topic").agg(
        F.count(F.lit(1)).alias("n_posts"), F.count_if(hit).alias("n_watched")
    )


@query(
    "daily_activity",
    o.with_ctes(
        ["mentions"],
        f"""SELECT {o.norm('key')} AS trend_term, CAST(created_at AS DATE) AS run_date,
              count(*) AS mention_count, sum(tenths) / 10.0 AS engagement_score
            FROM mentions GROUP BY 1, 2""",
    ),
)
def _(spark, sf):
    return mentions.daily_activity(mentions.mentions(_posts(spark, sf)))


@query(
    "normalized_terms",
    o.with_ctes(
        ["scored"],
        f"SELECT {o.norm('term')} AS norm_key, count(*) AS spellings, string_agg(term, '|' ORDER BY term) AS terms FROM scored GROUP BY 1",
    ),
)
def _(spark, sf):
    stats = mentions.supported_post_stats(_posts(spark, sf))
    named = mentions.with_scores(stats)
    # One key has at most a handful of spellings: one per family and mark.
    return ranking.by_norm(named).groupBy("norm_key").agg(
        F.count(F.lit(1)).alias("spellings"),
        F.array_join(F.sort_array(F.collect_list("term")), "|").alias("terms"),
    )


# The queries of the same names without "all_" keep to terms with three mentions of two authors.
_ALL_SCORED = o.scored_sql("stats")


def _all_scored(spark, sf):
    """Every term of every family with its scores."""
    return mentions.with_scores(mentions.post_stats(_posts(spark, sf)))


@query(
    "all_ngram_trends",
    o.with_ctes(["ngram_mentions"], f"SELECT {_STATS} FROM ({o.stats_sql('ngram_mentions')}) s"),
)
def _(spark, sf):
    return mentions.post_stats(_posts(spark, sf), (mentions.NGRAM,)).select(*STATS)


@query(
    "all_trend_scores",
    o.with_ctes(["stats"], f"SELECT {_SCORES} FROM all_scored", all_scored=_ALL_SCORED),
)
def _(spark, sf):
    return _all_scored(spark, sf).select(*_SCORES.split(", "))


@query(
    "all_trend_quality",
    o.with_ctes(
        ["stats"], f"SELECT term_type, key, {o.QUALITY} AS qualified FROM all_scored", all_scored=_ALL_SCORED
    ),
)
def _(spark, sf):
    return mentions.with_quality(_all_scored(spark, sf)).select("term_type", "key", "qualified")


@query(
    "all_unique_trends",
    o.with_ctes(
        ["stats"],
        f"""SELECT term_type, key, {o.norm('term')} AS norm_key FROM (
              SELECT *, row_number() OVER (PARTITION BY {o.norm('term')} ORDER BY {o.BEST}) AS rn FROM all_scored) u
            WHERE rn = 1""",
        all_scored=_ALL_SCORED,
    ),
)
def _(spark, sf):
    kept = ranking.unique_trends(_all_scored(spark, sf))
    return kept.select("term_type", "key", "norm_key")


@query(
    "all_normalized_terms",
    o.with_ctes(
        ["stats"],
        f"SELECT {o.norm('term')} AS norm_key, count(*) AS spellings, string_agg(term, '|' ORDER BY term) AS terms FROM all_scored GROUP BY 1",
        all_scored=_ALL_SCORED,
    ),
)
def _(spark, sf):
    return ranking.by_norm(_all_scored(spark, sf).select("term")).groupBy("norm_key").agg(
        F.count(F.lit(1)).alias("spellings"),
        F.array_join(F.sort_array(F.collect_list("term")), "|").alias("terms"),
    )
