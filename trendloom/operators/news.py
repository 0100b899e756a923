"""News selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.operators.ranking import keep_first


def fetch_news(news: DataFrame, max_per_query: int | None = 5) -> DataFrame:
    """The first articles of each query, each URL once, under its first query.

    Without a cap all articles count, and no query's articles meet in one task: copies of a URL are
    told apart by the order of their queries and their rank alone.
    """
    filled = news.select(
        "query",
        "ord",
        "rnk",
        F.coalesce("title", F.lit("No Title")).alias("title"),
        F.coalesce("body", F.lit("")).alias("body"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("source", F.lit("Unknown")).alias("source"),
        F.coalesce("date", F.lit("")).alias("date"),
    )
    if max_per_query is None:
        rest = [c for c in filled.columns if c != "url"]
        first = filled.groupBy("url").agg(F.min_by(F.struct(*rest), F.struct("ord", "rnk")).alias("a"))
        return first.select("url", "a.*")
    rank = Window.partitionBy("query").orderBy("rnk", "url")
    capped = filled.withColumn("query_rank", F.row_number().over(rank)).where(F.col("query_rank") <= max_per_query)
    return keep_first(capped, ["url"], [F.asc("ord"), F.asc("query_rank")])
