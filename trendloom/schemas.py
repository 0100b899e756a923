"""Table schemas."""

RAW_POST = """
    id BIGINT, rawContent STRING, user STRUCT<username: STRING, displayname: STRING>,
    date TIMESTAMP_NTZ, likeCount INT, retweetCount INT, replyCount INT, viewCount INT,
    lang STRING, hashtags ARRAY<STRING>
"""

POST = """
    id BIGINT, text STRING, username STRING, display_name STRING, created_at TIMESTAMP_NTZ,
    likes INT, retweets INT, replies INT, views INT, language STRING, is_retweet BOOLEAN,
    hashtags ARRAY<STRING>
"""

_STATE_POST = POST.replace("\n", " ").strip()
_STATE_FIELDS = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in _STATE_POST.split(","))

# A run's saved state: collected posts, and posts per trend.
RUN_STATE = f"""
    run_id STRING, started_at STRING, topics_completed ARRAY<STRING>,
    topics_remaining ARRAY<STRING>, retry_counts MAP<STRING, INT>,
    broad_tweets ARRAY<STRUCT<{_STATE_FIELDS}>>, trends ARRAY<STRING>,
    trend_tweets MAP<STRING, ARRAY<STRUCT<{_STATE_FIELDS}>>>
"""

TREND_HISTORY = "trend_term STRING, mention_count INT, engagement_score DOUBLE, run_date DATE"

DIGEST = """
    id BIGINT, trends ARRAY<STRING>, tweet_count INT, digest_text STRING,
    signal_strength STRING, top_engagement DOUBLE, notable BOOLEAN,
    created_at TIMESTAMP_NTZ, run_date DATE
"""

MEMORY = """
    id STRING, date TIMESTAMP_NTZ, trends ARRAY<STRING>, trend_categories ARRAY<STRING>,
    signal_strength STRING, sentiment STRING, top_engagement DOUBLE, themes ARRAY<STRING>,
    summary STRING, full_digest STRING, notable BOOLEAN, tweet_count INT,
    created_at TIMESTAMP_NTZ, embedding ARRAY<DOUBLE>
"""

INGEST_LOG = "run_date DATE, topic STRING, attempt BIGINT, n_posts BIGINT"

RUN_METRICS = """
    run_id BIGINT, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, broad_posts BIGINT,
    deep_dive_posts BIGINT, trends_discovered BIGINT, sources_active BIGINT, sources_total BIGINT,
    report_sent BOOLEAN, errors ARRAY<STRING>, warnings ARRAY<STRING>
"""

NEWS = "query STRING, ord INT, rnk BIGINT, title STRING, body STRING, url STRING, source STRING, date STRING"
