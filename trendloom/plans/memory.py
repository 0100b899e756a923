"""Queries over the memory of past days: records, search, look-ups, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.functions import constants, digest_text
from trendloom.operators import memory
from trendloom.plans import oracle as o
from trendloom.plans import testdata as td
from trendloom.plans.registry import query
from trendloom.session import work_folder
from trendloom.sources import tables

# The highest cosine between two vectors of the test data is about 0.5.
FLOOR = 0.25


def similar(spark, sf):
    """The newest memory of each label as current conditions, searched among all others."""
    memories = td.derived(spark, sf, "memories")
    newest = memories.groupBy("label").agg(
        F.max_by(F.struct("id", "embedding"), F.struct("date", "id")).alias("m")
    )
    queries = newest.select(
        F.col("m.id").alias("query_id"), F.col("m.embedding").alias("query_embedding")
    )
    return memory.search(memories, queries, k=5, min_similarity=FLOOR)


_HITS = {
    "newest": """SELECT id AS query_id, embedding AS qe FROM (
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY date DESC, id DESC) AS rn FROM memories) m WHERE rn = 1""",
    "scored_pairs": """SELECT query_id, id, round(list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 12) AS similarity
      FROM newest JOIN memories ON id <> query_id""",
    "hits": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS match_rank
        FROM scored_pairs WHERE similarity >= {FLOOR}) r WHERE match_rank <= 5""",
}


@query(
    "similar_memories",
    o.with_ctes(
        ["memories"],
        """SELECT query_id, id, CAST(match_rank AS INT) AS match_rank, round(similarity, 6) AS similarity,
             round(1 - similarity, 6) AS distance FROM hits""",
        **_HITS,
    ),
)
def _(spark, sf):
    return similar(spark, sf).select(
        "query_id", "id", "match_rank", F.round("similarity", 6).alias("similarity"),
        F.round("distance", 6).alias("distance"),
    )


@query(
    "memory_neighbours",
    o.with_ctes(
        ["memories"],
        """SELECT query_id, id, CAST(match_rank AS INT) AS match_rank, round(similarity, 6) AS similarity FROM (
             SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS match_rank FROM (
               SELECT q.id AS query_id, m.id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[])), 12) AS similarity
               FROM memories q JOIN memories m ON q.id <> m.id) s) r WHERE match_rank <= 3""",
    ),
)
def _(spark, sf):
    """The three most similar memories of every memory: as many queries as memories."""
    memories = td.derived(spark, sf, "memories")
    queries = memories.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    hits = memory.search(memories, queries, k=3, min_similarity=-1.0)
    return hits.select("query_id", "id", "match_rank", F.round("similarity", 6).alias("similarity"))


@query(
    "parallels_within_budget",
    o.with_ctes(
        ["memories"],
        """SELECT query_id, id, band, CAST(rn AS INT) AS budget_rank FROM (
             SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY band = 'moderate', similarity DESC, id) AS rn FROM (
               SELECT *, CASE WHEN similarity > 0.33 THEN 'strong' WHEN similarity > 0.27 THEN 'moderate' END AS band FROM hits) b
             WHERE band IS NOT NULL) r WHERE rn <= 3""",
        **_HITS,
    ),
)
def _(spark, sf):
    hits = memory.parallels_within_budget(similar(spark, sf), strong=0.33, moderate=0.27)
    return hits.select("query_id", "id", "band", "budget_rank")


@query(
    "recent_memories",
    o.with_ctes(["memories"], "SELECT id, date, notable FROM memories WHERE date BETWEEN DATE '2024-01-30' - 7 AND DATE '2024-01-30'"),
)
def _(spark, sf):
    rows = memory.get_recent(td.derived(spark, sf, "memories"), td.MEMORY_AS_OF)
    return rows.select("id", "date", "notable")


@query(
    "notable_memories",
    o.with_ctes(["memories"], "SELECT id, date FROM memories WHERE notable ORDER BY date DESC, id LIMIT 10"),
)
def _(spark, sf):
    return memory.get_notable(td.derived(spark, sf, "memories")).select("id", "date")


@query("memory_count", o.with_ctes(["memories"], "SELECT count(*) AS n_memories FROM memories"))
def _(spark, sf):
    return memory.count(td.derived(spark, sf, "memories"))


def digest_table(spark, sf):
    """Digests with a text: the analyses, dated and rated by their number."""
    return td.derived(spark, sf, "analyses").select(
        "digest_id",
        F.date_sub(F.lit(td.MEMORY_AS_OF), F.col("digest_id").cast("int")).alias("run_date"),
        "trends",
        "digest_text",
        F.when(F.col("digest_id") % 3 == 0, "high").otherwise("low").alias("signal_strength"),
        (F.col("digest_id") % 1000 / 1.0).alias("top_engagement"),
        (F.col("digest_id") % 3 == 0).alias("notable"),
        (F.col("digest_id") % 500).cast("int").alias("tweet_count"),
    )


_BULL = "contains(lower(digest_text), 'bullish')"
_BEAR = "contains(lower(digest_text), 'bearish')"
_SENTIMENT = f"""CASE WHEN {_BULL} AND NOT {_BEAR} THEN 'bullish' WHEN {_BEAR} AND NOT {_BULL} THEN 'bearish'
  WHEN {_BULL} AND {_BEAR} OR contains(lower(digest_text), 'mixed') THEN 'mixed' ELSE 'neutral' END"""


def _category(t: str) -> str:
    return f"""CASE WHEN starts_with({t}, '$') THEN 'stock' WHEN starts_with({t}, '#') THEN 'hashtag'
      WHEN regexp_matches(lower({t}), '{o.flat(constants.COMMODITY_KEYWORDS)}') THEN 'commodity'
      WHEN regexp_matches(lower({t}), '{o.flat(constants.SECTOR_KEYWORDS)}') THEN 'sector' ELSE 'general' END"""


_CATEGORIES = f"list_sort(list_distinct(list_transform(trends, lambda t: {_category('t')})))"
_STRIP = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+\z', '', 'g')"


def _section(name: str) -> str:
    body = rf"regexp_extract(digest_text, '(?is)\*\*{name}(?::\*\*|\*\*:?)[\s\p{{Z}}]*(.+?)(?:\n\*\*|\z)', 1)"
    return rf"nullif(regexp_replace({_STRIP.format(x=body)}, '[\s\p{{Z}}]+', ' ', 'g'), '')"


_SUMMARY = f"""substring(coalesce({_section('bottom line')}, {_section('summary')}, {_section('assessment')},
  split_part(digest_text, chr(10) || chr(10), 1)), 1, 500)"""
# Themes as rows: bullets first, then what the bottom line is about; first spelling wins, ten at most.
_THEMES = {
    "found": r"""SELECT digest_id, 0 AS part, generate_subscripts(b, 1) AS pos, unnest(b) AS theme FROM (
        SELECT digest_id, regexp_extract_all(regexp_extract(digest_text, '(?is)\*\*trends observed(?::\*\*|\*\*:?)\s*\n(.*?)(?:\n\*\*|\z)', 1),
          '[-•][\s\p{Z}]*([^\n]+)', 1) AS b FROM analyses) x
      UNION ALL
      SELECT digest_id, 1, generate_subscripts(a, 1), unnest(a) FROM (
        SELECT digest_id, regexp_extract_all(regexp_extract(digest_text, '(?is)\*\*(?:bottom line|summary)(?::\*\*|\*\*:?)[\s\p{Z}]*(.+?)(?:\n\*\*|\z)', 1),
          '(?i)(?:about|regarding|concerning)[\s\p{Z}]+([^,.]+)', 1) AS a FROM analyses) y""",
    "stripped": f"SELECT digest_id, part, pos, {_STRIP.format(x='theme')} AS theme FROM found",
    "firsts": """SELECT *, row_number() OVER (PARTITION BY digest_id ORDER BY part, pos) AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY digest_id, lower(theme) ORDER BY part, pos) AS rn
        FROM stripped WHERE length(theme) > 3) s WHERE rn = 1""",
    "theme_lists": """SELECT digest_id, count(*) AS n_themes, string_agg(theme, ', ' ORDER BY place) AS themes
      FROM firsts WHERE place <= 10 GROUP BY 1""",
}


@query("digest_sentiment", o.with_ctes(["analyses"], f"SELECT digest_id, {_SENTIMENT} AS sentiment FROM analyses"))
def _(spark, sf):
    return td.derived(spark, sf, "analyses").select(
        "digest_id", digest_text.sentiment(F.col("digest_text")).alias("sentiment")
    )


@query(
    "digest_categories",
    o.with_ctes(
        ["analyses"], f"SELECT digest_id, array_to_string({_CATEGORIES}, ',') AS categories FROM analyses"
    ),
)
def _(spark, sf):
    return td.derived(spark, sf, "analyses").select(
        "digest_id",
        F.array_join(digest_text.trend_categories(F.col("trends")), ",").alias("categories"),
    )


@query(
    "digest_themes",
    o.with_ctes(["analyses"], "SELECT * FROM theme_lists", **_THEMES),
)
def _(spark, sf):
    rows = td.derived(spark, sf, "analyses").select(
        "digest_id", digest_text.themes(F.col("digest_text")).alias("t")
    )
    return rows.where(F.size("t") > 0).select(
        "digest_id",
        F.size("t").cast("bigint").alias("n_themes"),
        F.array_join("t", ", ").alias("themes"),
    )


@query("digest_summaries", o.with_ctes(["analyses"], f"SELECT digest_id, {_SUMMARY} AS summary FROM analyses"))
def _(spark, sf):
    return td.derived(spark, sf, "analyses").select(
        "digest_id", digest_text.summary(F.col("digest_text")).alias("summary")
    )


_DAY = "(DATE '2024-01-30' - CAST(digest_id AS INT))"


@query(
    "memory_records",
    o.with_ctes(
        ["analyses"],
        f"""SELECT 'memory_' || strftime({_DAY}, '%Y%m%d') AS id, {_DAY} AS date, {_SENTIMENT} AS sentiment,
              md5('Date: ' || strftime({_DAY}, '%Y-%m-%d') || chr(10) || 'Signal: ' || CASE WHEN digest_id % 3 = 0 THEN 'high' ELSE 'low' END
                || chr(10) || 'Sentiment: ' || {_SENTIMENT} || chr(10) || 'Trends: ' || array_to_string(trends, ', ')
                || chr(10) || 'Categories: ' || array_to_string({_CATEGORIES}, ', ') || chr(10) || 'Themes: ' || coalesce(themes, '')
                || chr(10) || 'Summary: ' || {_SUMMARY}) AS embedding_md5
            FROM analyses LEFT JOIN theme_lists USING (digest_id)""",
        **_THEMES,
    ),
)
def _(spark, sf):
    records = memory.memory_records(digest_table(spark, sf))
    return records.select("id", "date", "sentiment", F.md5("embedding_text").alias("embedding_md5"))


@query(
    "memory_query_texts",
    o.with_ctes(
        ["analyses"],
        f"""SELECT digest_id, 'Trends: ' || array_to_string(trends, ', ') || chr(10) || 'Themes: ' || coalesce(themes, '') || chr(10)
              || 'Sentiment: ' || {_SENTIMENT} || chr(10) || 'Signal: ' || 'unknown' AS query_text
            FROM analyses LEFT JOIN theme_lists USING (digest_id)""",
        **_THEMES,
    ),
)
def _(spark, sf):
    body = F.col("digest_text")
    return td.derived(spark, sf, "analyses").select(
        "digest_id",
        digest_text.query_text(
            F.col("trends"), digest_text.themes(body), digest_text.sentiment(body), F.lit("unknown")
        ).alias("query_text"),
    )


@query(
    "memory_by_date",
    o.with_ctes(
        ["analyses"],
        f"""SELECT 'memory_' || strftime({_DAY}, '%Y%m%d') AS id, {_SENTIMENT} AS sentiment
            FROM analyses WHERE {_DAY} = DATE '2024-01-20'""",
    ),
)
def _(spark, sf):
    records = memory.memory_records(digest_table(spark, sf))
    return memory.get_by_date(records, td.AS_OF).select("id", "sentiment")


@query("embedded_memories")
def _(spark, sf):
    """Embedded memories with their similarity to the newest one. No SQL: hashed features."""
    records = memory.memory_records(digest_table(spark, sf)).select("id", "date", "embedding_text")
    embedded = memory.embed(records, "embedding_text")
    newest = embedded.agg(F.max_by(F.struct("id", "embedding"), "date").alias("m")).select(
        F.col("m.id").alias("query_id"), F.col("m.embedding").alias("query_embedding")
    )
    return memory.search(embedded, newest, k=20, min_similarity=0.1)


@query(
    "memories_upserted",
    o.with_ctes(
        ["memories"],
        """SELECT CAST(id AS VARCHAR) AS id, notable <> (label < 5) AS notable, label,
             date + INTERVAL 1 HOUR AS created_at FROM memories""",
    ),
)
def _(spark, sf):
    """Store memories, then store half of them again, changed and later."""
    rows = td.derived(spark, sf, "memories").select(
        F.col("id").cast("string").alias("id"), "date", "label", "notable",
        (F.col("date").cast("timestamp_ntz") + F.expr("INTERVAL 1 HOUR")).alias("created_at"),
    )
    path = work_folder(spark, "memories")
    tables.store_memories(rows, path)
    again = rows.where("label < 5").select(
        "id", "date", "label", (~F.col("notable")).alias("notable"),
        (F.col("created_at") + F.expr("INTERVAL 9 HOURS")).alias("created_at"),
    )
    tables.store_memories(again, path)
    return tables.read_memories(spark, path).select("id", "notable", "label", "created_at")


@query(
    "memory_list_codec",
    o.with_ctes(
        ["analyses"],
        """SELECT digest_id, '["' || array_to_string(trends, '","') || '"]' AS trends_json,
             array_to_string(trends, '|') AS trends FROM analyses""",
    ),
)
def _(spark, sf):
    rows = td.derived(spark, sf, "analyses").select("digest_id", "trends")
    encoded = tables.encode_lists(rows, "trends").select(
        "digest_id", F.col("trends").alias("trends_json"), "trends"
    )
    return tables.decode_lists(encoded, "trends").withColumn("trends", F.array_join("trends", "|"))
