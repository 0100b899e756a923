"""History tables: append, and upsert by key with dynamic partition overwrite."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom import schemas
from trendloom.session import delete_folder, discard, folder_exists, written


def store_posts(posts: DataFrame, path: str) -> None:
    """Append posts, one folder per day and topic; a busy topic is written by as many tasks as its size needs."""
    rows = posts.withColumn("run_date", F.to_date("created_at"))
    rows.hint("rebalance", "run_date", "topic").write.mode("append").partitionBy("run_date", "topic").parquet(path)


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.POST + ", run_date DATE, topic STRING").parquet(path)


def digest_rows(runs: DataFrame) -> DataFrame:
    """Digest rows with a stable id: the moment of the run in microseconds, so runs of one day differ."""
    return runs.withColumn("id", F.unix_micros(F.col("created_at").cast("timestamp")))


_MONTH = "yyyy-MM"


def store_digests(runs: DataFrame, path: str) -> None:
    """Append digests, one folder per month: a run is one row, too little for a folder."""
    rows = digest_rows(runs).withColumn("month", F.date_format("run_date", _MONTH))
    rows.hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(path)


def read_digests(
    spark: SparkSession, path: str, since: dt.date | None = None, until: dt.date | None = None
) -> DataFrame:
    """Digests of the days from since to until; only the folders of their months are read."""
    rows = spark.read.schema(schemas.DIGEST + ", month STRING").parquet(path)
    if since is not None:
        rows = rows.where((F.col("month") >= f"{since:%Y-%m}") & (F.col("run_date") >= F.lit(since)))
    if until is not None:
        rows = rows.where((F.col("month") <= f"{until:%Y-%m}") & (F.col("run_date") <= F.lit(until)))
    return rows.drop("month")


def latest_versions(
    old: DataFrame,
    new: DataFrame,
    key: list[str],
    keep_earliest: str | None = None,
    version: str | None = None,
) -> DataFrame:
    """Union in which new rows replace old rows of the same key.

    Of several new rows of a key the one with the greatest ``version`` stays, and among equals the
    one with the greatest hash. ``keep_earliest`` names a column whose smallest value survives the
    replacement. One aggregation, combined before the shuffle, so many versions of one key cost one
    row per task.
    """
    rest = [c for c in new.columns if c not in key]
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    order = ["_v", *([version] if version else []), F.xxhash64(*rest)]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    kept = {c: F.col(f"_row.{c}") for c in rest}
    if keep_earliest is None:
        merged = both.groupBy(*key).agg(newest)
    else:
        merged = both.groupBy(*key).agg(newest, F.min(keep_earliest).alias("_earliest"))
        kept[keep_earliest] = F.col("_earliest")
    return merged.select(*key, *[c.alias(n) for n, c in kept.items()]).select(*new.columns)


MAX_LISTED_PARTITIONS = 5000


def _in_same_partitions(old: DataFrame, new: DataFrame, partition: str) -> DataFrame:
    """Old rows in the partitions that new rows touch.

    A short list of partition values becomes a literal filter, so other partitions are not read.
    """
    touched = new.select(partition).distinct()
    values = [r[0] for r in touched.limit(MAX_LISTED_PARTITIONS + 1).collect()]
    if len(values) > MAX_LISTED_PARTITIONS:
        return old.join(touched, partition, "left_semi")
    return old.where(F.col(partition).isin(values))


def _replace_partitions(spark: SparkSession, merged: str, path: str, partition: str) -> None:
    """Put a complete table of merged partitions in the place of the old ones, then delete it."""
    rows = spark.read.parquet(merged)
    (
        rows.hint("rebalance", partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
    delete_folder(spark, merged)


def upsert_partitions(
    new: DataFrame,
    path: str,
    key: list[str],
    partition: str,
    keep_earliest: str | None = None,
    version: str | None = None,
) -> None:
    """Insert or replace rows by key, rewriting only the partitions that new rows touch.

    The key contains the partition column, so a key never moves between partitions. The merged
    partitions are first written as a whole to ``_merged`` inside the table, which readers do not
    see, and only then replace the old ones. If that is interrupted, the next call finds the
    complete ``_merged`` and finishes the replacement before it does anything else.
    """
    spark = new.sparkSession
    merged = f"{path}/_merged"
    if folder_exists(spark, f"{merged}/_SUCCESS"):
        _replace_partitions(spark, merged, path, partition)
    try:
        old = spark.read.schema(new.schema).parquet(path)
    except AnalysisException as error:  # the first write creates the table
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        old = spark.createDataFrame([], new.schema)
    new = written(new, "new-rows")
    rows = latest_versions(_in_same_partitions(old, new, partition), new, key, keep_earliest, version)
    rows.write.mode("overwrite").parquet(merged)
    _replace_partitions(spark, merged, path, partition)
    discard(new)


def store_trend_history(rows: DataFrame, path: str, version: str | None = None) -> None:
    upsert_partitions(rows, path, ["trend_term", "run_date"], "run_date", version=version)


def read_trend_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TREND_HISTORY).parquet(path)


def memory_part(id_column: Column) -> Column:
    """The folder of a memory: a function of its id, so a memory has one place.

    Ids made of a day lie in the folder of its month, all others in one of 64 by hash.
    """
    by_hash = F.format_string("h%02d", F.pmod(F.xxhash64(id_column.cast("string")), F.lit(64)))
    dated = id_column.cast("string").rlike("^memory_[0-9]{8}$")
    return F.when(dated, F.substring(id_column.cast("string"), 8, 6)).otherwise(by_hash)


def store_memories(rows: DataFrame, path: str) -> None:
    """Upsert memories by id; created_at keeps the earliest, and of new rows of an id the latest stays."""
    placed = rows.withColumn("part", memory_part(F.col("id")))
    upsert_partitions(placed, path, ["id", "part"], "part", keep_earliest="created_at", version="created_at")


def read_memories(spark: SparkSession, path: str, memory_id: str | None = None) -> DataFrame:
    """All memories, or the one of an id, for which one folder is read."""
    rows = spark.read.parquet(path)
    if memory_id is not None:
        part = spark.range(1).select(memory_part(F.lit(memory_id))).first()[0]
        rows = rows.where((F.col("part").cast("string") == part) & (F.col("id") == memory_id))
    return rows.drop("part")


def encode_lists(rows: DataFrame, *columns: str) -> DataFrame:
    """List columns as JSON text, for exchange with systems without lists."""
    return rows.withColumns({c: F.to_json(c) for c in columns})


def decode_lists(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.from_json(c, "array<string>") for c in columns})
