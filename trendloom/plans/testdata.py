"""Post, history, market, memory and run tables derived from the given base tables.

Every adapter is a projection or a grouping of whole tables, so the derived tables grow with
the base tables. The base tables hold no tickers, hashtags or claims; one of sixteen phrases is
appended to each text.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from trendloom.session import tasks_for

AS_OF = dt.date(2024, 1, 20)
MARKET_AS_OF = dt.date(2000, 6, 30)
DIGEST_AS_OF = dt.date(1999, 6, 30)
MEMORY_AS_OF = dt.date(2024, 1, 30)

PHRASES = (
    "$NVDA breaking out on huge volume #stocks",
    "$NVDA up 12% today, bullish #trading",
    "$COST sold out of eggs again",
    "silver shortage at the warehouse #silver $SLV",
    "egg shortage is getting worse",
    "just watched a great movie #cinema",
    "$TSLA crashing 8% premarket $TSLA",
    "copper supply deficit growing $FCX #copper",
    "semiconductor layoffs hitting suppliers $AMD",
    "read this https://example.com/a @newsdesk $AAPL",
    "RTX 5090 price hike, nobody can afford it #gpu",
    "gold at a 52w high, massive volume $GLD",
    "nothing to see here",
    "nvidia allocation delayed #nvda",
    "oil futures up 3% on supply news $XLE",
    "tariff talk and freight backlog #tariffs",
)
SYMBOLS = (
    "NVDA", "TSLA", "SLV", "FCX", "AMD", "AAPL", "GLD", "XLE", "GC=F", "SI=F", "CL=F",
    "BTC-USD", "^GSPC", "SPY",
)
TREND_NAMES = (
    "$NVDA", "#silver", "Gold Futures", "Egg Shortage", "Tech Layoffs", "Crude Oil", "S&P 500",
    "Bitcoin Rally", "Solar Energy", "Real Estate",
)


def choose(number: str, values: tuple[str, ...]) -> str:
    """SQL that picks one of the values by a number."""
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE ({number}) % {len(values)} {cases} END"


POSTS = f"""
SELECT id, text, username, display_name, created_at, likes, retweets, replies, views, language,
       is_retweet, regexp_extract_all(text, '#([A-Za-z]+)', 1) AS hashtags, topic
FROM (
  SELECT doc_id AS id,
         concat(CASE WHEN doc_id % 17 = 0 THEN 'RT @user1: ' ELSE '' END, text, ' ',
                {choose('doc_id', PHRASES)}) AS text,
         concat('user', CAST((doc_id * 7) % 53 AS VARCHAR(20))) AS username,
         concat('User ', CAST((doc_id * 7) % 53 AS VARCHAR(20))) AS display_name,
         {{seconds_after_new_year}} AS created_at,
         CAST(n_chars % 997 AS INT) AS likes,
         CAST((doc_id * 13) % 211 AS INT) AS retweets,
         CAST(doc_id % 29 AS INT) AS replies,
         CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(n_chars * 3 AS INT) END AS views,
         lang AS language,
         doc_id % 17 = 0 AS is_retweet,
         source AS topic
  FROM {{documents}}
) d
"""

SPARK_SECONDS = (
    "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id * 7919 % 2592000)"
)
DUCKDB_SECONDS = "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 7919 % 2592000)"

TREND_HISTORY = """
SELECT concat(event_type, '_', CAST(user_id AS VARCHAR(20))) AS trend_term,
       CAST(ts AS DATE) AS run_date,
       CAST(count(*) AS INT) AS mention_count,
       sum(CAST(round(value * 100) AS BIGINT)) / 1e2 AS engagement_score
FROM {events}
GROUP BY 1, 2
"""

BARS = f"""
SELECT {choose('l_suppkey', SYMBOLS)} AS symbol, CAST(l_shipdate AS DATE) AS date,
       max(l_extendedprice / l_quantity) AS close,
       CAST(sum(l_quantity) AS BIGINT) AS volume
FROM {{lineitem}}
GROUP BY 1, 2
"""

DIGESTS = f"""
SELECT run_date, tweet_count, top_engagement, trend_count, signal_strength,
       signal_strength = 'high' AS notable, trends
FROM (
  SELECT CAST(o_orderdate AS DATE) AS run_date,
         CAST(count(*) AS INT) AS tweet_count,
         max(o_totalprice) AS top_engagement,
         CAST(count(DISTINCT o_orderpriority) AS INT) AS trend_count,
         CASE WHEN max(o_totalprice) > 450000 THEN 'high'
              WHEN max(o_totalprice) > 300000 THEN 'medium'
              WHEN max(o_totalprice) > 100000 THEN 'low' ELSE 'none' END AS signal_strength,
         {{array}}({choose('min(o_orderkey)', TREND_NAMES)},
                   {choose('max(o_orderkey) + 3', TREND_NAMES)},
                   {choose('min(o_custkey) + 5', TREND_NAMES)},
                   {choose('max(o_custkey) + 7', TREND_NAMES)}) AS trends
  FROM {{orders}}
  GROUP BY 1
) g
"""

# A digest text per document: bold headings, the whole document, bullets and a closing line.
ANALYSES = f"""
SELECT doc_id AS digest_id,
       concat(CASE WHEN doc_id % 5 = 0 THEN concat('**Subject Line**: "Run ', CAST(doc_id AS VARCHAR(20)), '"', chr(10),
                        '**Signal Strength**: ', {choose('doc_id', ('High', 'Medium', 'None', 'Low'))}, chr(10)) ELSE '' END,
              CASE WHEN doc_id % 4 = 3 THEN '' ELSE concat('**Assessment:**', chr(10), text, chr(10), chr(10)) END,
              '**Trends Observed:**', chr(10),
              '- ', {choose('doc_id', TREND_NAMES)}, chr(10),
              '- ', {choose('doc_id + 4', TREND_NAMES)}, chr(10),
              '• ', upper({choose('doc_id', TREND_NAMES)}), chr(10),
              '- ', lang, chr(10),
              CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat(chr(10), '**Bottom Line:**', chr(10), 'Talk about ',
                   {choose('doc_id', PHRASES)}, '. Mood is ',
                   {choose('doc_id', ('bullish', 'bearish', 'mixed', 'calm', 'bullish and bearish'))},
                   ',  questions regarding ', source, ' remain.') END) AS digest_text,
       {{array}}({choose('doc_id', TREND_NAMES)}, {choose('doc_id + 4', TREND_NAMES)}) AS trends
FROM {{documents}}
"""

MEMORIES = """
SELECT vec_id AS id, label, vec_id % 10 = 0 AS notable,
       {days_before_as_of} AS date, embedding
FROM {embeddings}
"""

NEWS = f"""
SELECT query, CAST(ord AS INT) AS ord, page_id AS rnk,
       nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, html AS body, url,
       CASE WHEN page_id % 7 = 0 THEN NULL ELSE concat('site', CAST(page_id % 5 AS VARCHAR(20))) END AS source
FROM (
  SELECT page_id, url, html, k AS ord,
         {choose('k', ('economy news', 'stock market news', 'supply chain'))} AS query
  FROM (SELECT page_id, url, html, {{explode}}({{array}}(page_id % 3, (page_id + 1) % 3)) AS k FROM {{pages}}) e
) q
"""

INGEST_LOG = """
SELECT CAST(ts AS DATE) AS run_date,
       concat('src', CAST(user_id % 44 AS VARCHAR(20))) AS topic,
       event_id AS attempt,
       CASE WHEN event_type = 'error' OR user_id % 44 < 3 THEN 0 ELSE 1 END AS n_posts
FROM {events}
"""

RUN_METRICS = """
SELECT o_orderkey AS run_id,
       o_orderdate AS start_time,
       {run_end} AS end_time,
       CASE WHEN o_orderkey % 31 = 0 THEN 0 ELSE CAST(o_custkey % 400 AS INT) END AS broad_posts,
       CASE WHEN o_orderkey % 31 = 0 THEN 0 ELSE CAST(o_orderkey % 90 AS INT) END AS deep_dive_posts,
       CAST(o_custkey % 12 AS INT) AS trends_discovered,
       CAST(o_orderkey % 8 AS INT) AS sources_active,
       CAST(7 + o_custkey % 3 AS INT) AS sources_total,
       o_orderstatus <> 'F' OR o_orderkey % 2 = 0 AS report_sent,
       CASE WHEN o_orderstatus = 'F' THEN {array}('timeout', 'parse error') ELSE {no_texts} END AS errors,
       CASE WHEN o_orderpriority = '1-URGENT' THEN {array}('Failed to store memory: disk', 'slow source')
            WHEN o_orderpriority = '2-HIGH' THEN {array}('slow source') ELSE {no_texts} END AS warnings
FROM {orders}
"""

QUOTE_LOG = f"""
SELECT {choose('l_suppkey', SYMBOLS)} AS symbol,
       l_extendedprice / l_quantity AS current_price,
       {{minutes_after_ship}} AS fetched_at
FROM {{lineitem}}
"""

PRICE_LOG = f"""
SELECT {choose('user_id', SYMBOLS)} AS symbol, value AS current_price, ts AS fetched_at,
       event_id AS quote_id
FROM {{events}}
"""

RAW_POSTS = f"""
SELECT doc_id AS id,
       CASE WHEN doc_id % 23 = 0 THEN NULL
            ELSE concat(CASE WHEN doc_id % 17 = 0 THEN 'RT @user1: ' ELSE '' END, text) END AS raw_content,
       CASE WHEN doc_id % 19 = 0 THEN NULL ELSE concat('user', CAST((doc_id * 7) % 53 AS VARCHAR(20))) END AS user_name,
       CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(n_chars % 997 AS INT) END AS like_count,
       CASE WHEN doc_id % 12 = 0 THEN NULL ELSE CAST((doc_id * 13) % 211 AS INT) END AS retweet_count,
       CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(doc_id % 29 AS INT) END AS reply_count,
       CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(n_chars * 3 AS INT) END AS view_count,
       {{seconds_after_new_year}} AS created_at, lang
FROM {{documents}}
"""

_SPARK = {
    "array": "array",
    "explode": "explode",
    "no_texts": "CAST(array() AS ARRAY<STRING>)",
    "seconds_after_new_year": SPARK_SECONDS,
    "days_before_as_of": "date_sub(DATE '2024-01-30', CAST(vec_id % 3650 AS INT))",
    "run_end": "o_orderdate + make_dt_interval(0, 0, 0, o_orderkey * 37 % 9000)",
    "minutes_after_ship": "l_shipdate + make_dt_interval(0, 0, CAST(l_orderkey % 1440 AS INT), 0)",
}
_DUCKDB = {
    "array": "list_value",
    "explode": "unnest",
    "no_texts": "CAST([] AS VARCHAR[])",
    "seconds_after_new_year": DUCKDB_SECONDS,
    "days_before_as_of": "DATE '2024-01-30' - CAST(vec_id % 3650 AS INT)",
    "run_end": "o_orderdate + to_seconds(o_orderkey * 37 % 9000)",
    "minutes_after_ship": "l_shipdate + to_minutes(l_orderkey % 1440)",
}
_TABLES = ("documents", "events", "lineitem", "orders", "embeddings", "pages")

SQL = {
    "posts": POSTS,
    "trend_history": TREND_HISTORY,
    "bars": BARS,
    "digests": DIGESTS,
    "analyses": ANALYSES,
    "memories": MEMORIES,
    "news": NEWS,
    "ingest_log": INGEST_LOG,
    "run_metrics": RUN_METRICS,
    "quote_log": QUOTE_LOG,
    "price_log": PRICE_LOG,
    "raw_posts": RAW_POSTS,
}


def duckdb_sql(name: str) -> str:
    return SQL[name].format(**_DUCKDB, **{t: t for t in _TABLES}).strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The base tables are few files: deal them to tasks of bounded size, as many files would be."""
    tasks = tasks_for(df)
    return df if not tasks or len(df.inputFiles()) >= tasks else df.repartition(tasks, key)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the base tables of one scale factor."""
    sql = SQL[name]
    used = {t: table(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in sql}
    if "documents" in used:
        used["documents"] = spread(used["documents"], "doc_id")
    return spark.sql(sql.format(**_SPARK, **{t: "{" + t + "}" for t in _TABLES}), **used)


def post_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts table as a file stream. The table is one file or a folder of parts: a pattern finds both."""
    schema = table(spark, sf_dir, "documents").schema
    documents = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents[.]parquet")
    return spark.sql(POSTS.format(**_SPARK, documents="{documents}"), documents=documents)
