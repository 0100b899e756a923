"""Memory of past days: records, embeddings, similarity search."""

from __future__ import annotations

import datetime as dt

from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline, PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions import digest_text, scoring
from trendloom.operators import nearest


def memory_id(column: str = "date") -> F.Column:
    return F.concat(F.lit("memory_"), F.date_format(column, "yyyyMMdd"))


def memory_records(digests: DataFrame) -> DataFrame:
    """Structured memories from digests: categories, sentiment, themes, summary, text to embed."""
    body = F.col("digest_text")
    records = digests.select(
        memory_id("run_date").alias("id"),
        F.col("run_date").alias("date"),
        "trends",
        digest_text.trend_categories(F.col("trends")).alias("trend_categories"),
        "signal_strength",
        digest_text.sentiment(body).alias("sentiment"),
        "top_engagement",
        digest_text.themes(body).alias("themes"),
        digest_text.summary(body).alias("summary"),
        body.alias("full_digest"),
        "notable",
        "tweet_count",
    )
    return records.withColumn(
        "embedding_text",
        digest_text.memory_text(
            F.col("date"),
            F.col("signal_strength"),
            F.col("sentiment"),
            F.col("trends"),
            F.col("trend_categories"),
            F.col("themes"),
            F.col("summary"),
        ),
    )


def embedder(texts: DataFrame, text_column: str, features: int = 1024) -> PipelineModel:
    """A fitted embedding of hashed words, weighted by how rare they are in the given texts."""
    return Pipeline(
        stages=[
            RegexTokenizer(
                inputCol=text_column, outputCol="_words", pattern=r"[^\p{L}\p{N}_$#]+"
            ),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_idf"),
            Normalizer(inputCol="_idf", outputCol="_unit"),
        ]
    ).fit(texts)


def embedded(texts: DataFrame, model: PipelineModel) -> DataFrame:
    """Add a unit-length ``embedding`` to texts under the column the model was fitted to."""
    vectors = model.transform(texts).withColumn("embedding", vector_to_array("_unit"))
    return vectors.drop("_words", "_tf", "_idf", "_unit")


def embed(texts: DataFrame, text_column: str, features: int = 1024) -> DataFrame:
    """Embed texts with the word weights of the same texts. No remote service."""
    return embedded(texts, embedder(texts, text_column, features))


def search(
    memories: DataFrame, queries: DataFrame, k: int = 5, min_similarity: float = 0.6, part_rows: int = nearest.PART_ROWS
) -> DataFrame:
    """The k most similar other memories of each query, best first, above a threshold.

    ``queries`` has a unique ``query_id``, of the type of the memory ids, and ``query_embedding``.
    Both sides may be large: they meet by parts of at most about ``part_rows`` memories.
    """
    return nearest.nearest(memories, queries, k, min_similarity, part_rows)


def parallels_within_budget(
    hits: DataFrame, budget: int = 3, strong: float = 0.75, moderate: float = 0.6
) -> DataFrame:
    """Strong matches first, then moderate ones, up to the budget per query."""
    band = scoring.match_band(F.col("similarity"), strong, moderate)
    banded = hits.withColumn("band", band).where("band is not null")
    order = Window.partitionBy("query_id").orderBy(
        F.when(F.col("band") == "strong", 0).otherwise(1), F.desc("similarity"), "id"
    )
    return banded.withColumn("budget_rank", F.row_number().over(order)).where(
        F.col("budget_rank") <= budget
    )


def get_by_date(memories: DataFrame, day: dt.date) -> DataFrame:
    return memories.where(F.col("id") == f"memory_{day:%Y%m%d}")


def get_recent(memories: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    """Memories from as_of - days to the end of as_of, newest first."""
    start, end = (F.lit(as_of + dt.timedelta(days=n)).cast(memories.schema["date"].dataType) for n in (-days, 1))
    return memories.where((F.col("date") >= start) & (F.col("date") < end)).orderBy(F.desc("date"), "id")


def get_notable(memories: DataFrame, limit: int = 10) -> DataFrame:
    return memories.where("notable").orderBy(F.desc("date"), "id").limit(limit)


def count(memories: DataFrame) -> DataFrame:
    return memories.agg(F.count(F.lit(1)).alias("n_memories"))
