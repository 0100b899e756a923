"""Distinct authors of terms over any span of days, from sketches stored by term and day.

A sketch holds a bounded number of bytes however many authors it has seen, and sketches of several
days are united without their posts. With 2**12 slots the relative standard error of an estimate is
1.6 percent; up to some hundred authors it is exact.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions import text
from trendloom.sources.tables import upsert_partitions

LOG_SLOTS = 12
SCHEMA = "trend_term STRING, authors BINARY, run_date DATE"


def daily_sketches(mention_rows: DataFrame) -> DataFrame:
    """trend_term (normalized), authors (a sketch) and run_date."""
    keyed = mention_rows.select(text.normalized_key(F.col("key")).alias("trend_term"), "username", F.to_date("created_at").alias("run_date"))
    sketch = F.hll_sketch_agg("username", F.lit(LOG_SLOTS)).alias("authors")
    return keyed.groupBy("trend_term", "run_date").agg(sketch).select("trend_term", "authors", "run_date")


def store_sketches(rows: DataFrame, path: str) -> None:
    """Insert or replace the sketches of the given terms and days."""
    upsert_partitions(rows, path, ["trend_term", "run_date"], "run_date")


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def authors_between(sketches: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """trend_term, active_days and authors of the days from first to last; only their folders are read."""
    span = sketches.where(F.col("run_date").between(F.lit(first), F.lit(last)))
    return span.groupBy("trend_term").agg(
        F.countDistinct("run_date").alias("active_days"),
        F.hll_sketch_estimate(F.hll_union_agg("authors")).alias("authors"),
    )
