"""Queries over posts: sources, cleaning, term extraction, topics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from trendloom.functions import constants, scoring, text
from trendloom.operators import health, mentions, phrases, ranking
from trendloom.plans import oracle as o
from trendloom.plans import testdata as td
from trendloom.plans.registry import query
from trendloom.session import work_folder
from trendloom.sources import posts as source
from trendloom.sources import tables


@query(
    "posts_normalized",
    o.with_ctes(
        ["raw_posts"],
        """SELECT id, md5(raw_content) AS text_md5, coalesce(user_name, 'unknown') AS username,
             CASE WHEN user_name IS NULL THEN 'Unknown' ELSE upper(user_name) END AS display_name,
             created_at, coalesce(like_count, 0) AS likes, coalesce(retweet_count, 0) AS retweets,
             coalesce(reply_count, 0) AS replies, view_count AS views, lang AS language,
             coalesce(starts_with(raw_content, 'RT @'), false) AS is_retweet, 0 AS n_hashtags
           FROM raw_posts""",
    ),
)
def _(spark, sf):
    raw = td.derived(spark, sf, "raw_posts").select(
        "id",
        F.col("raw_content").alias("rawContent"),
        F.when(
            F.col("user_name").isNotNull(),
            F.struct(
                F.col("user_name").alias("username"), F.upper("user_name").alias("displayname")
            ),
        ).alias("user"),
        F.col("created_at").alias("date"),
        F.col("like_count").alias("likeCount"),
        F.col("retweet_count").alias("retweetCount"),
        F.col("reply_count").alias("replyCount"),
        F.col("view_count").alias("viewCount"),
        "lang",
        F.lit(None).cast("array<string>").alias("hashtags"),
    )
    rows = source.normalize_raw_posts(raw)
    return rows.select(
        "id", F.md5("text").alias("text_md5"), "username", "display_name", "created_at", "likes",
        "retweets", "replies", "views", "language", "is_retweet",
        F.size("hashtags").alias("n_hashtags"),
    )


@query(
    "posts_per_topic",
    o.with_ctes(
        ["posts"],
        """SELECT topic, id, CAST(rk AS INT) AS topic_rank FROM (
             SELECT *, row_number() OVER (PARTITION BY topic ORDER BY created_at DESC, id) AS rk
             FROM posts WHERE language = 'en') r WHERE rk <= 200""",
    ),
)
def _(spark, sf):
    rows = source.select_per_topic(td.derived(spark, sf, "posts"))
    return rows.select("topic", "id", "topic_rank")


_STATUS_SQL = """SELECT run_date, topic, count(*) AS attempts,
    count(*) FILTER (n_posts = 0) AS empty_attempts, CAST(sum(n_posts) AS BIGINT) AS n_posts,
    CASE WHEN sum(n_posts) > 0 THEN 'complete' WHEN count(*) FILTER (n_posts = 0) > 3 THEN 'complete_empty'
         ELSE 'retry' END AS status
  FROM ingest_log GROUP BY 1, 2"""


@query(
    "posts_of_outstanding_topics",
    o.with_ctes(
        ["posts", "ingest_log"],
        """SELECT id, topic FROM posts WHERE topic NOT IN (
             SELECT topic FROM status WHERE run_date = DATE '2024-01-19' AND status <> 'retry')""",
        status=_STATUS_SQL,
    ),
)
def _(spark, sf):
    status = health.ingest_status(td.derived(spark, sf, "ingest_log"))
    today = status.where(F.col("run_date") == F.lit(dt.date(2024, 1, 19)))
    return source.outstanding_posts(td.derived(spark, sf, "posts"), today).select("id", "topic")


@query("ingest_status", o.with_ctes(["ingest_log"], _STATUS_SQL))
def _(spark, sf):
    return health.ingest_status(td.derived(spark, sf, "ingest_log"))


@query(
    "ingest_attempts",
    o.with_ctes(
        ["posts", "ingest_log"],
        """SELECT DATE '2024-01-20' AS run_date, topic, CAST(1 AS BIGINT) AS attempt, count(id) AS n_posts
           FROM (SELECT DISTINCT topic FROM ingest_log) t LEFT JOIN posts USING (topic) GROUP BY topic""",
    ),
)
def _(spark, sf):
    topics = td.derived(spark, sf, "ingest_log").select("topic").distinct()
    return health.attempt_rows(topics, td.derived(spark, sf, "posts"), td.AS_OF, 1)


@query(
    "posts_stored",
    o.with_ctes(
        ["posts"],
        """SELECT id, md5(text) AS text_md5, topic, CAST(created_at AS DATE) AS run_date, likes, views,
             array_to_string(hashtags, ',') AS hashtags FROM posts""",
    ),
)
def _(spark, sf):
    """Posts written to a table partitioned by day and topic, and read back."""
    path = work_folder(spark, "posts")
    tables.store_posts(td.derived(spark, sf, "posts"), path)
    return tables.read_posts(spark, path).select(
        "id", F.md5("text").alias("text_md5"), "topic", "run_date", "likes", "views",
        F.array_join("hashtags", ",").alias("hashtags"),
    )


def _saved_states(spark, sf):
    """Post rows written as saved run states and read back."""
    posts = td.derived(spark, sf, "posts").drop("topic")
    named = F.array_distinct(text.cashtags(F.col("text")))
    states = posts.select(F.struct(*posts.columns).alias("p"), named.alias("named")).select(
        F.array("p").alias("broad_tweets"),
        F.map_from_entries(
            F.transform("named", lambda t: F.struct(t, F.array(F.col("p"))))
        ).alias("trend_tweets"),
    )
    path = work_folder(spark, "states")
    states.write.json(path)
    return spark, path


@query(
    "state_posts",
    o.with_ctes(
        ["posts"],
        """SELECT id, md5(text) AS text_md5, username, display_name, created_at, likes, retweets, replies,
             views, language, is_retweet, array_to_string(hashtags, ',') AS hashtags FROM posts""",
    ),
)
def _(spark, sf):
    spark, path = _saved_states(spark, sf)
    rows = source.state_posts(source.read_run_states(spark, path, multi_line=False))
    return rows.withColumn("hashtags", F.array_join("hashtags", ",")).select(
        "id", F.md5("text").alias("text_md5"), "username", "display_name", "created_at", "likes",
        "retweets", "replies", "views", "language", "is_retweet", "hashtags",
    )


@query(
    "state_trend_posts",
    o.with_ctes(
        ["posts"],
        f"""SELECT trend, count(*) AS n_posts, CAST(sum(likes) AS BIGINT) AS likes
            FROM (SELECT DISTINCT unnest({o.cashtags('text')}) AS trend, id, likes FROM posts) t
            GROUP BY 1""",
    ),
)
def _(spark, sf):
    spark, path = _saved_states(spark, sf)
    rows = source.state_trend_posts(source.read_run_states(spark, path, multi_line=False))
    return rows.groupBy("trend").agg(
        F.count(F.lit(1)).alias("n_posts"), F.sum("likes").alias("likes")
    )


@query(
    "post_engagement",
    o.with_ctes(["posts"], f"SELECT id, is_retweet, {o.tenths()} / 10.0 AS engagement FROM posts"),
)
def _(spark, sf):
    score = scoring.engagement(F.col("likes"), F.col("retweets"), F.col("replies"))
    return td.derived(spark, sf, "posts").select("id", "is_retweet", score.alias("engagement"))


@query(
    "clean_texts",
    o.with_ctes(
        ["posts"],
        f"""SELECT id, length(c) AS n_chars, md5(c) AS clean_md5
            FROM (SELECT id, {o.clean('text')} AS c FROM posts) t""",
    ),
)
def _(spark, sf):
    cleaned = td.derived(spark, sf, "posts").select("id", text.clean_text(F.col("text")).alias("c"))
    return cleaned.select(
        "id", F.length("c").cast("bigint").alias("n_chars"), F.md5("c").alias("clean_md5")
    )


@query(
    "post_cashtags",
    o.with_ctes(
        ["posts"],
        f"""SELECT id, ticker, count(*) AS n
            FROM (SELECT id, unnest({o.cashtags('text')}) AS ticker FROM posts) t GROUP BY 1, 2""",
    ),
)
def _(spark, sf):
    found = td.derived(spark, sf, "posts").select(
        "id", F.explode(text.cashtags(F.col("text"))).alias("ticker")
    )
    return found.groupBy("id", "ticker").agg(F.count(F.lit(1)).alias("n"))


@query(
    "post_hashtags",
    o.with_ctes(
        ["posts"],
        f"""SELECT id, tag FROM (SELECT id, trim(lower(unnest(hashtags)), '#') AS tag FROM posts) t
            WHERE length(tag) BETWEEN 3 AND 25 AND NOT {o.noise('tag')}""",
    ),
)
def _(spark, sf):
    return td.derived(spark, sf, "posts").select(
        "id", F.explode(text.hashtag_keys(F.col("hashtags"))).alias("tag")
    )


@query(
    "noise_words",
    o.with_ctes(
        ["posts"],
        f"""SELECT word, {o.noise('word')} AS noise FROM (
              SELECT DISTINCT unnest(string_split(lower({o.clean('text')}), ' ')) AS word FROM posts) w""",
    ),
)
def _(spark, sf):
    words = F.split(F.lower(text.clean_text(F.col("text"))), " ")
    distinct = td.derived(spark, sf, "posts").select(F.explode(words).alias("word")).distinct()
    return distinct.select("word", text.is_noise(F.col("word")).alias("noise"))


@query(
    "post_context",
    o.with_ctes(["facts"], "SELECT id, has_cashtag, has_context FROM facts"),
)
def _(spark, sf):
    facts = mentions.post_facts(td.derived(spark, sf, "posts"))
    return facts.select("id", "has_cashtag", "has_context")


@query(
    "post_context_whole_words",
    o.with_ctes(
        ["posts"],
        rf"""SELECT id, len({o.cashtags('text')}) > 0 OR regexp_matches(lower(text),
              '(?:^|[^\p{{L}}\p{{N}}_])(?:{o.flat(constants.CONTEXT_TERMS)})(?:$|[^\p{{L}}\p{{N}}_])') AS has_context
            FROM posts""",
    ),
)
def _(spark, sf):
    rules = text.TermRules(match="word")
    return td.derived(spark, sf, "posts").select(
        "id", text.has_context(F.col("text"), rules).alias("has_context")
    )


@query(
    "post_ngrams",
    o.with_ctes(
        ["facts", "post_terms"],
        """SELECT id, count(key) AS n_terms, md5(coalesce(string_agg(key, '|' ORDER BY key), '')) AS terms_md5
           FROM facts LEFT JOIN post_terms USING (id) GROUP BY id""",
    ),
)
def _(spark, sf):
    posts = mentions.post_facts(td.derived(spark, sf, "posts"))
    words = mentions.with_term_words(posts)
    keys = text.ngram_keys(F.col("line"), F.col("inner"), F.col("outer"))
    terms = words.select("id", keys.alias("terms"))
    return terms.select(
        "id",
        F.size("terms").cast("bigint").alias("n_terms"),
        F.md5(F.array_join(F.sort_array("terms"), "|")).alias("terms_md5"),
    )


@query(
    "post_previews",
    o.with_ctes(
        ["posts"],
        """SELECT id, md5(substring(text, 1, 200)) AS sample_md5, md5(substring(text, 1, 500)) AS shown_md5,
             CASE WHEN length(text) > 150 THEN substring(text, 1, 150) || '...' ELSE text END AS preview
           FROM posts""",
    ),
)
def _(spark, sf):
    body = F.col("text")
    short = F.when(F.length(body) > 150, F.concat(F.substring(body, 1, 150), F.lit("..."))).otherwise(body)
    return td.derived(spark, sf, "posts").select(
        "id",
        F.md5(F.substring(body, 1, 200)).alias("sample_md5"),
        F.md5(F.substring(body, 1, 500)).alias("shown_md5"),
        short.alias("preview"),
    )


def _topics(spark):
    return spark.createDataFrame([(t,) for t in constants.DEFAULT_TOPICS], "topic STRING")


_PLAIN = r"""concat(' ', trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '(^|[^\p{L}\p{N}_])''+', '\1 ', 'g'), '''+([^\p{L}\p{N}_]|$)', ' \1', 'g'), '[^\p{L}\p{N}_$#''%&]+', ' ', 'g'), ' '), ' ')"""


@query(
    "topic_matches",
    o.with_ctes(
        ["posts"],
        "SELECT DISTINCT p.id, a.topic FROM plain p JOIN alternatives a ON contains(p.t, concat(' ', a.phrase, ' '))",
        plain=f"SELECT id, {_PLAIN} AS t FROM posts",
        alternatives=f"""SELECT topic, unnest(string_split(topic, ' OR ')) AS phrase
                         FROM (SELECT unnest([{o.quoted(constants.DEFAULT_TOPICS)}]) AS topic) t""",
    ),
)
def _(spark, sf):
    return ranking.topic_matches(td.derived(spark, sf, "posts"), _topics(spark))


@query(
    "opening_phrases",
    o.with_ctes(
        ["posts"],
        """SELECT phrase, count(*) AS n_posts, min(id) AS first_id FROM found JOIN openings USING (phrase) GROUP BY phrase""",
        split_posts=f"SELECT id, string_split(trim({_PLAIN}, ' '), ' ') AS w FROM posts",
        openings="""SELECT DISTINCT array_to_string(w[1:2], ' ') AS phrase FROM split_posts WHERE len(w) >= 2
                    UNION SELECT DISTINCT array_to_string(w[1:3], ' ') FROM split_posts WHERE len(w) >= 3""",
        placed_words="SELECT id, w, unnest(range(1, len(w) + 1)) AS k FROM split_posts",
        found="""SELECT DISTINCT id, array_to_string(w[k:k + 1], ' ') AS phrase FROM placed_words WHERE k < len(w)
                 UNION ALL SELECT DISTINCT id, array_to_string(w[k:k + 2], ' ') FROM placed_words WHERE k + 1 < len(w)""",
    ),
)
def _(spark, sf):
    """Every beginning of a post of two or three words, and the posts that hold it anywhere."""
    posts = td.derived(spark, sf, "posts").select("id", "text")
    words = posts.select(phrases.phrase_words(F.col("text")).alias("w"), F.explode(F.array(F.lit(2), F.lit(3))).alias("n"))
    openings = words.where("size(w) >= n").select(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("phrase")).distinct()
    hits = phrases.phrase_hits(posts, openings)
    return hits.groupBy("phrase").agg(F.count("*").alias("n_posts"), F.min("id").alias("first_id"))


@query(
    "posts_deduplicated",
    o.with_ctes(
        ["posts"],
        """SELECT id, min(topic) AS topic FROM (
             SELECT id, topic FROM posts UNION ALL
             SELECT id, concat('src', CAST(id % 20 AS VARCHAR)) AS topic FROM posts) u GROUP BY id""",
    ),
)
def _(spark, sf):
    posts = td.derived(spark, sf, "posts")
    again = posts.withColumn("topic", F.concat(F.lit("src"), (F.col("id") % 20).cast("string")))
    return ranking.dedupe_posts(posts.unionByName(again)).select("id", "topic")


@query(
    "posts_from_all_searches",
    o.with_ctes(
        ["posts"],
        """SELECT topic, count(*) AS n_posts, count(DISTINCT id) AS n_distinct FROM (
             SELECT id, topic FROM posts UNION ALL SELECT id, topic FROM posts WHERE language = 'en') u
           GROUP BY topic""",
    ),
)
def _(spark, sf):
    posts = td.derived(spark, sf, "posts").select("id", "topic", "language")
    both = posts.unionByName(posts.where("language = 'en'"))
    return both.groupBy("topic").agg(
        F.count(F.lit(1)).alias("n_posts"), F.countDistinct("id").alias("n_distinct")
    )
