"""Queries over post streams, each run to the end of what is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.operators import market
from trendloom.operators import mentions as m
from trendloom.plans import oracle as o
from trendloom.plans import testdata as td
from trendloom.plans.registry import query
from trendloom.session import work_folder
from trendloom.streaming import closed_windows
from trendloom.streaming import posts_stream as ps

@query(
    "stream_ingested_activity",
    o.with_ctes(
        ["mentions"],
        f"""SELECT {o.norm('key')} AS trend_term, CAST(created_at AS DATE) AS run_date,
              count(*) AS mention_count, sum(tenths) / 10.0 AS engagement_score
            FROM mentions GROUP BY 1, 2""",
    ),
)
def _(spark, sf):
    folder = work_folder(spark, "ingest")
    ps.ingest_activity(td.post_stream(spark, sf), folder)
    return ps.ingested_activity(spark, folder)


@query(
    "stream_deduplicated",
    o.with_ctes(["posts"], "SELECT id, topic, created_at FROM posts"),
)
def _(spark, sf):
    """The stream delivers every post twice; each id comes out once."""
    twice = td.post_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = ps.run_available(ps.deduplicated(twice).drop("copy"), "dedupe")
    return rows.select("id", "topic", "created_at")


_CLOSED = "(SELECT max(created_at) - INTERVAL 1 DAY FROM facts)"

# Every mention in the six sliding windows it falls into, as far as these are closed.
_WINDOWS = {
    "in_windows": f"""SELECT * FROM (
        SELECT *, date_trunc('hour', created_at) - to_hours(i) AS window_start FROM mentions, range(0, 6) r(i)) w
      WHERE window_start + INTERVAL 6 HOURS <= {_CLOSED.replace('facts', 'posts')}""",
    "window_stats": """SELECT window_start, term_type, key, count(*) AS mention_count, count(DISTINCT username) AS unique_authors,
        sum(tenths) / 10.0 AS total_engagement,
        count(*) FILTER (term_type = 'cashtag' OR has_context) AS financial_context_count,
        count(*) FILTER (term_type <> 'cashtag' AND has_cashtag) AS cashtag_cooccurrence_count
      FROM in_windows GROUP BY 1, 2, 3""",
    "scored_windows": o.scored_sql("window_stats"),
}
_WINDOW_COLUMNS = """window_start, window_start + INTERVAL 6 HOURS AS window_end, term_type, key, mention_count,
  unique_authors, total_engagement, velocity_score, composite_score"""


@query(
    "stream_daily_counts",
    o.with_ctes(
        ["mentions", "facts"],
        f"""SELECT run_date, term_type, key, mention_count, unique_authors, total_engagement FROM (
              SELECT CAST(created_at AS DATE) AS run_date, term_type, key, count(*) AS mention_count,
                count(DISTINCT username) AS unique_authors, sum(tenths) / 10.0 AS total_engagement FROM mentions GROUP BY 1, 2, 3) d
            WHERE run_date + INTERVAL 1 DAY <= {_CLOSED.replace('facts', 'posts')}""",
    ),
)
def _(spark, sf):
    """Closed days only: a day is emitted once the watermark has passed its end."""
    return ps.daily_counts(td.post_stream(spark, sf), work_folder(spark, "daily"))


@query(
    "stream_sliding_scores",
    o.with_ctes(
        ["mentions", "posts"],
        f"SELECT {_WINDOW_COLUMNS} FROM scored_windows",
        **_WINDOWS,
    ),
)
def _(spark, sf):
    return ps.sliding_scores(td.post_stream(spark, sf), work_folder(spark, "sliding"))


def _late_run(spark, sf, term_types=m.ALL_TYPES):
    """Two runs over the same folder: the second half of the month, then the first half."""
    posts = td.derived(spark, sf, "posts").drop("topic")
    folder = work_folder(spark, "arrivals")
    second = F.col("created_at") >= "2024-01-15"
    state = work_folder(spark, "late")
    for part in (posts.where(second), posts.where(~second)):
        part.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(posts.schema).parquet(folder)
        rows = ps.daily_counts(stream, state, term_types=term_types)
    return rows, state, posts


@query(
    "stream_late_posts",
    o.with_ctes(
        ["mentions", "posts"],
        f"""SELECT run_date, term_type, key, mention_count, unique_authors FROM (
              SELECT CAST(created_at AS DATE) AS run_date, term_type, key, count(*) AS mention_count,
                count(DISTINCT username) AS unique_authors
              FROM mentions WHERE created_at >= DATE '2024-01-15' GROUP BY 1, 2, 3) d
            WHERE run_date + INTERVAL 1 DAY <= {_CLOSED.replace('facts', 'posts')}""",
    ),
)
def _(spark, sf):
    """The first half of the month arrives after the second half is closed: too late to count."""
    rows, _, _ = _late_run(spark, sf)
    return rows.select("run_date", "term_type", "key", "mention_count", "unique_authors")


@query(
    "stream_late_days",
    o.with_ctes(
        ["posts"],
        """SELECT CAST(created_at AS DATE) AS run_date, count(*) AS late_posts, count(DISTINCT username) AS late_authors
           FROM posts WHERE created_at < DATE '2024-01-15' GROUP BY 1""",
    ),
)
def _(spark, sf):
    """The late posts of the run above are a table of their own, which outlives the run."""
    _, state, posts = _late_run(spark, sf, (m.CASHTAG,))
    late = closed_windows.late_posts(spark, state, posts)
    return late.groupBy(F.to_date("created_at").alias("run_date")).agg(
        F.count(F.lit(1)).alias("late_posts"), F.countDistinct("username").alias("late_authors")
    )


@query(
    "stream_hot_terms",
    o.with_ctes(
        ["mentions", "posts"],
        f"""SELECT * FROM (SELECT {_WINDOW_COLUMNS}, CAST(row_number() OVER (
              PARTITION BY window_start ORDER BY composite_score DESC, term_type, key) AS INT) AS window_rank
            FROM scored_windows) r WHERE window_rank <= 10""",
        **_WINDOWS,
    ),
)
def _(spark, sf):
    """The hottest terms of all families per sliding window."""
    scored = ps.sliding_scores(td.post_stream(spark, sf), work_folder(spark, "hot"))
    return ps.hottest_per_window(scored)


@query(
    "stream_topic_engagement",
    o.with_ctes(
        ["posts"],
        f"""SELECT date_trunc('hour', created_at) AS window_start, topic, count(*) AS n_posts, sum({o.tenths()}) / 10.0 AS engagement
            FROM posts GROUP BY 1, 2
            HAVING date_trunc('hour', any_value(created_at)) + INTERVAL 1 HOUR <= (SELECT max(created_at) - INTERVAL 1 DAY FROM posts)""",
    ),
)
def _(spark, sf):
    return ps.run_available(ps.stream_engagement(td.post_stream(spark, sf)), "topics")


@query(
    "stream_quoted_mentions",
    o.with_ctes(
        ["posts", "price_log"],
        """SELECT n.id, n.created_at, n.symbol, q.current_price, q.fetched_at FROM named n LEFT JOIN LATERAL (
             SELECT current_price, fetched_at FROM price_log q WHERE q.symbol = n.symbol
               AND q.fetched_at <= n.created_at AND q.fetched_at > n.created_at - INTERVAL 60 MINUTES
             ORDER BY fetched_at DESC, quote_id DESC LIMIT 1) q ON true""",
        named=f"""SELECT DISTINCT id, created_at, unnest({o.cashtags('text')}) AS symbol FROM posts WHERE NOT is_retweet""",
    ),
)
def _(spark, sf):
    quotes = td.derived(spark, sf, "price_log")
    rows = market.quotes_at_mention(td.post_stream(spark, sf), quotes, ttl_minutes=60)
    return ps.run_available(rows, "quoted")
