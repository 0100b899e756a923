"""Queries over digests, news and run health."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.functions import digest_text, scoring
from trendloom.operators import digests, health, news
from trendloom.plans import oracle as o
from trendloom.plans import testdata as td
from trendloom.plans.posts import _STATUS_SQL
from trendloom.plans.registry import query
from trendloom.plans.trends import _DEEP_SQL, deep_dive
from trendloom.session import work_folder
from trendloom.sources import tables

AS_OF = "DATE '1999-06-30'"
_STRIP = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+\z', '', 'g')"


@query(
    "sanitized_digests",
    o.with_ctes(
        ["analyses"],
        "SELECT digest_id, md5("
        + _STRIP.format(
            x="""regexp_replace(regexp_replace(translate(replace(raw, '\\n', chr(10)), '─│┌┐└┘', ' |++++'), '  +', ' ', 'g'),
               '([^' || chr(10) || '])•', '\\1' || chr(10) || '•', 'g')"""
        )
        + ") AS body_md5 FROM messy",
        messy=r"SELECT digest_id, replace(replace(digest_text, chr(10) || '• ', '─• '), '. ', '.\n  │') AS raw FROM analyses",
    ),
)
def _(spark, sf):
    body = F.replace(F.col("digest_text"), F.lit("\n• "), F.lit("─• "))
    messy = F.replace(body, F.lit(". "), F.lit(".\\n  │"))
    return td.derived(spark, sf, "analyses").select(
        "digest_id", F.md5(digest_text.sanitize(messy)).alias("body_md5")
    )


@query(
    "recovered_digests",
    o.with_ctes(
        ["analyses"],
        "SELECT digest_id, nullif("
        + _STRIP.format(
            x=r"""regexp_extract(digest_text, '(?i)\*\*subject line\*\*:[\s\p{Z}]*["'']?([^"''\n]+)["'']?', 1)"""
        )
        + r""", '') AS subject,
            CASE WHEN contains(upper(digest_text), 'HIGH') AND contains(upper(digest_text), 'SIGNAL') THEN 'high'
                 WHEN contains(upper(digest_text), 'MEDIUM') AND contains(upper(digest_text), 'SIGNAL') THEN 'medium'
                 WHEN contains(upper(digest_text), 'NONE') AND contains(upper(digest_text), 'SIGNAL') THEN 'none' ELSE 'low' END AS signal_strength,
            md5("""
        + _STRIP.format(
            x=r"""regexp_replace(digest_text, '(?i)\*\*(?:subject line|signal strength)\*\*:[\s\p{Z}]*[^\n]*\n*', '', 'g')"""
        )
        + ") AS body_md5 FROM analyses",
    ),
)
def _(spark, sf):
    body = F.col("digest_text")
    return td.derived(spark, sf, "analyses").select(
        "digest_id",
        digest_text.recovered_subject(body).alias("subject"),
        digest_text.recovered_signal(body).alias("signal_strength"),
        F.md5(digest_text.recovered_body(body)).alias("body_md5"),
    )


@query(
    "signal_strengths",
    o.with_ctes(
        ["digests"],
        """SELECT run_date, top_engagement, trend_count, s AS signal_strength, s = 'high' AS notable FROM (
             SELECT *, CASE WHEN trend_count = 0 THEN 'none' WHEN top_engagement / 60000 > 5 AND trend_count >= 3 THEN 'high'
               WHEN top_engagement / 60000 > 2 OR trend_count >= 5 THEN 'medium' WHEN top_engagement / 60000 > 0.5 THEN 'low'
               ELSE 'none' END AS s FROM digests) d""",
    ),
)
def _(spark, sf):
    runs = td.derived(spark, sf, "digests").select("run_date", "top_engagement", "trend_count")
    return digests.with_signal(runs, baseline=60000.0)


@query(
    "calendar_context",
    o.with_ctes(
        ["digests"],
        """SELECT run_date, dayname(run_date) AS weekday_name, isodow(run_date) >= 6 AS is_weekend,
             month(run_date) IN (1, 4, 7, 10) AND day(run_date) <= 21 AS is_early_quarter FROM digests""",
    ),
)
def _(spark, sf):
    days = td.derived(spark, sf, "digests").select("run_date")
    return days.select("run_date", scoring.calendar_context(F.col("run_date")).alias("c")).select(
        "run_date", "c.*"
    )


@query(
    "recent_digests",
    o.with_ctes(
        ["digests"],
        f"""SELECT run_date, tweet_count, top_engagement, signal_strength, notable, array_to_string(trends, ',') AS trends
            FROM digests WHERE run_date BETWEEN {AS_OF} - 7 AND {AS_OF}""",
    ),
)
def _(spark, sf):
    rows = digests.recent_digests(td.derived(spark, sf, "digests"), td.DIGEST_AS_OF)
    return rows.select(
        "run_date", "tweet_count", "top_engagement", "signal_strength", "notable",
        F.array_join("trends", ",").alias("trends"),
    )


_BASELINE = f"""SELECT count(*) AS total_runs, round(coalesce(avg(top_engagement), 0), 4) AS avg_top_engagement,
    round(coalesce(avg(tweet_count), 0), 6) AS avg_tweets, count(*) FILTER (notable) AS notable_days,
    CASE WHEN count(*) > 0 THEN count(*) FILTER (notable) / count(*) ELSE 0 END AS notable_rate
  FROM digests WHERE run_date BETWEEN {AS_OF} - 30 AND {AS_OF}"""


@query("baseline_stats", o.with_ctes(["digests"], _BASELINE))
def _(spark, sf):
    stats = digests.baseline_stats(td.derived(spark, sf, "digests"), td.DIGEST_AS_OF)
    return stats.withColumn("avg_top_engagement", F.round("avg_top_engagement", 4)).withColumn(
        "avg_tweets", F.round("avg_tweets", 6)
    )


@query(
    "digest_context_lines",
    o.with_ctes(
        ["digests"],
        f"""SELECT run_date, array_to_string(trends[1:3], ',') AS top_trends, signal_strength, top_engagement, notable,
              total_runs, notable_rate
            FROM (SELECT * FROM digests WHERE run_date BETWEEN {AS_OF} - 7 AND {AS_OF} ORDER BY run_date DESC LIMIT 5) d, ({_BASELINE}) b""",
    ),
)
def _(spark, sf):
    lines = digests.context_lines(td.derived(spark, sf, "digests"), td.DIGEST_AS_OF)
    return lines.withColumn("top_trends", F.array_join("top_trends", ","))


@query(
    "digests_stored",
    o.with_ctes(
        ["digests"],
        """SELECT epoch_us(CAST(run_date AS TIMESTAMP)) AS id, run_date, tweet_count, top_engagement, signal_strength, notable,
             array_to_string(trends, ',') AS trends FROM digests""",
    ),
)
def _(spark, sf):
    """Append all digests in two writes and read the table back."""
    rows = td.derived(spark, sf, "digests").select(
        "trends", "tweet_count", F.lit("").alias("digest_text"), "signal_strength", "top_engagement",
        "notable", F.col("run_date").cast("timestamp_ntz").alias("created_at"), "run_date",
    )
    path = work_folder(spark, "digests")
    split = F.lit(td.DIGEST_AS_OF)
    tables.store_digests(rows.where(F.col("run_date") < split), path)
    tables.store_digests(rows.where(F.col("run_date") >= split), path)
    return tables.read_digests(spark, path).select(
        "id", "run_date", "tweet_count", "top_engagement", "signal_strength", "notable",
        F.array_join("trends", ",").alias("trends"),
    )


_NEWS = """SELECT query, ord, title, md5(body) AS body_md5, url, source FROM (
    SELECT *, row_number() OVER (PARTITION BY url ORDER BY ord, rk) AS first FROM (
      SELECT query, ord, coalesce(title, 'No Title') AS title, coalesce(body, '') AS body, coalesce(url, '') AS url,
        coalesce(source, 'Unknown') AS source, row_number() OVER (PARTITION BY query ORDER BY rnk, url) AS rk FROM news) r
    WHERE rk <= {cap}) f WHERE first = 1"""


def _news(spark, sf, cap):
    rows = td.derived(spark, sf, "news").withColumn("date", F.lit(None).cast("string"))
    return news.fetch_news(rows, cap)


@query("economic_news", o.with_ctes(["news"], _NEWS.format(cap=5)))
def _(spark, sf):
    return _news(spark, sf, 5).select(
        "query", "ord", "title", F.md5("body").alias("body_md5"), "url", "source"
    )


_ALL_NEWS = """SELECT query, ord, coalesce(title, 'No Title') AS title, md5(coalesce(body, '')) AS body_md5, coalesce(url, '') AS url,
    coalesce(source, 'Unknown') AS source
  FROM news QUALIFY row_number() OVER (PARTITION BY coalesce(url, '') ORDER BY ord, rnk) = 1"""


@query("economic_news_uncapped", o.with_ctes(["news"], _ALL_NEWS))
def _(spark, sf):
    return _news(spark, sf, None).select(
        "query", "ord", "title", F.md5("body").alias("body_md5"), "url", "source"
    )


@query(
    "run_totals",
    o.with_ctes(
        ["candidates", "posts", "ingest_log", "news"],
        f"""SELECT *, broad_posts + deep_dive_posts AS total_posts FROM
              (SELECT count(*) AS broad_posts FROM posts) a,
              (SELECT count(*) AS deep_dive_posts, count(DISTINCT trend) AS deep_dive_trends FROM deep) b,
              (SELECT count(*) AS topics_attempted, count(*) FILTER (status <> 'retry') AS topics_completed,
                 count(*) FILTER (status = 'complete') AS sources_active FROM status WHERE run_date = DATE '2024-01-20') c,
              (SELECT count(*) AS news_articles FROM fetched) d""",
        **_DEEP_SQL,
        status=_STATUS_SQL,
        fetched=_NEWS.format(cap=5),
    ),
)
def _(spark, sf):
    posts = td.derived(spark, sf, "posts")
    status = health.ingest_status(td.derived(spark, sf, "ingest_log"))
    today = status.where(F.col("run_date") == F.lit(td.AS_OF))
    return health.run_totals(posts, deep_dive(spark, sf)[1], today, _news(spark, sf, 5))


@query(
    "run_summary",
    o.with_ctes(
        ["candidates", "posts", "news"],
        f"""SELECT DATE '2024-01-20' AS run_date, array_to_string(trends, '|') AS trends, CAST(len(trends) AS INT) AS trend_count,
              tweet_count, top_engagement, news_count,
              CASE WHEN top_engagement / 200 > 5 AND len(trends) >= 3 THEN 'high'
                   WHEN top_engagement / 200 > 2 OR len(trends) >= 5 THEN 'medium'
                   WHEN top_engagement / 200 > 0.5 THEN 'low' ELSE 'none' END AS signal_strength,
              top_engagement / 200 > 5 AND len(trends) >= 3 AS notable
            FROM (SELECT list(term ORDER BY rank) AS trends FROM candidates) t,
              (SELECT count(*) AS tweet_count, coalesce(max({o.tenths()}) / 10.0, 0) AS top_engagement FROM deep) p,
              (SELECT count(*) AS news_count FROM fetched) n""",
        **_DEEP_SQL,
        fetched=_NEWS.format(cap=5),
    ),
)
def _(spark, sf):
    top, posts = deep_dive(spark, sf)
    row = digests.summary_row(td.AS_OF, top, posts, _news(spark, sf, 5), baseline=200.0)
    return row.withColumn("trends", F.array_join("trends", "|"))


_HEALTH = """SELECT run_id, p AS total_posts, epoch_us(end_time) / 1e6 - epoch_us(start_time) / 1e6 AS duration_seconds,
    critical, p < 100 OR trends_discovered = 0 OR sources_active < sources_total * 0.5 OR len(warnings) > 0 AS has_warnings,
    reason <> 'All systems operational' AS alert, split_part(severity_reason, '|', 1) AS severity, reason
  FROM (SELECT *, split_part(severity_reason, '|', 2) AS reason FROM (
    SELECT *, CASE
        WHEN critical AND p = 0 THEN 'critical|Zero posts collected'
        WHEN critical AND sources_active = 0 THEN 'critical|All sources unavailable'
        WHEN critical AND len(errors) > 0 THEN 'critical|' || len(errors) || ' error(s) occurred'
        WHEN len(list_filter(warnings, lambda w: contains(w, 'Failed to store memory'))) > 0 THEN 'warning|Memory storage failed - '
          || len(list_filter(warnings, lambda w: contains(w, 'Failed to store memory'))) || ' failure(s)'
        WHEN p < 50 THEN 'warning|Very low post count (' || p || ')'
        WHEN trends_discovered = 0 THEN 'warning|No trends discovered'
        WHEN sources_active < sources_total * 0.3 THEN 'warning|Only ' || sources_active || '/' || sources_total || ' sources active'
        ELSE 'ok|All systems operational' END AS severity_reason
    FROM (SELECT *, broad_posts + deep_dive_posts AS p,
            broad_posts + deep_dive_posts = 0 OR (sources_active = 0 AND sources_total > 0)
              OR (len(errors) > 0 AND NOT report_sent) AS critical FROM run_metrics) m) s) r"""


@query("run_health", o.with_ctes(["run_metrics"], _HEALTH))
def _(spark, sf):
    return health.run_health(td.derived(spark, sf, "run_metrics")).drop("duration")


@query(
    "run_durations",
    o.with_ctes(
        ["run_metrics"],
        """SELECT regexp_extract(d, '[smh]$') AS unit, count(*) AS n_runs FROM (
             SELECT CASE WHEN s < 60 THEN 's' WHEN s < 3600 THEN 'm' ELSE 'h' END AS d FROM (
               SELECT epoch(end_time) - epoch(start_time) AS s FROM run_metrics) x) y GROUP BY 1""",
    ),
)
def _(spark, sf):
    runs = health.run_health(td.derived(spark, sf, "run_metrics"))
    unit = F.regexp_extract("duration", "([smh])$", 1).alias("unit")
    return runs.groupBy(unit).agg(F.count(F.lit(1)).alias("n_runs"))


@query(
    "alerts_by_day",
    o.with_ctes(
        ["run_metrics"],
        """SELECT CAST(m.start_time AS DATE) AS day, h.severity, count(*) AS n_runs
           FROM run_metrics m JOIN health h USING (run_id) GROUP BY 1, 2""",
        health=_HEALTH,
    ),
)
def _(spark, sf):
    metrics = td.derived(spark, sf, "run_metrics")
    runs = health.run_health(metrics).select("run_id", "severity")
    days = metrics.select("run_id", F.to_date("start_time").alias("day"))
    return days.join(runs, "run_id").groupBy("day", "severity").agg(F.count(F.lit(1)).alias("n_runs"))


