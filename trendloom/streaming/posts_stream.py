"""Post streams: resumable ingest, deduplication, windowed counts and scores."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom import schemas
from trendloom.functions import scoring
from trendloom.functions.text import DEFAULT_RULES
from trendloom.operators import dealt
from trendloom.operators import mentions as m
from trendloom.session import GATHER_BYTES, batch_tasks, delete_folder, folder_exists, numbered_folders, work_folder
from trendloom.sources.posts import normalize_raw_posts
from trendloom.streaming import closed_windows
from trendloom.streaming.closed_windows import Windows


def read_raw_post_stream(
    spark: SparkSession, path: str, fmt: str = "json", max_files: int = 1000
) -> DataFrame:
    """Raw post files as a stream of batches of at most max_files files, so a backlog is taken in parts."""
    files = spark.readStream.schema(schemas.RAW_POST).option("maxFilesPerTrigger", max_files)
    return normalize_raw_posts(files.format(fmt).load(path))


def run_available(stream: DataFrame, purpose: str, checkpoint: str | None = None) -> DataFrame:
    """Process everything available into a table and return the table.

    With the same ``checkpoint`` a later call continues where this one stopped.
    """
    spark = stream.sparkSession
    folder = checkpoint or work_folder(spark, purpose)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _event_time(posts: DataFrame, delay: str) -> DataFrame:
    """Posts with a watermark. Watermarks need a time with zone; tables hold times without."""
    return posts.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark(
        "created_at", delay
    )


#: Parts of micro-batches beside the merged one before they are merged into it.
MAX_PARTS = 8
_ACTIVITY = "trend_term string, run_date date, mention_count long, engagement_score double"


#: Parts are blocks of counts by day, or plain rows where parts were merged.
_PART = f"{_ACTIVITY}, counts binary"
#: The day of posts without a time, and bounds around all days.
_NO_DAY, _ALL_DAYS = -(1 << 61), (-(1 << 62), 1 << 62)


def _activity_blocks(posts: DataFrame, term_types: tuple[str, ...]) -> DataFrame:
    """``mentions.daily_activity`` of the mentions of a micro-batch, as blocks for ``_activity_rows``."""
    tasks, groups = m.tasks_and_groups(batch_tasks(posts, GATHER_BYTES), posts.sparkSession.sparkContext.defaultParallelism)
    day = F.coalesce(F.unix_date(F.to_date("created_at")).cast("long"), F.lit(_NO_DAY))
    blocks = m.term_blocks(posts, tasks, groups, term_types, DEFAULT_RULES, {"time": day, "marks": m.post_marks()}, trimmed=True)
    count = dealt.window_counting(groups, 1, 1, *_ALL_DAYS, closed_windows.FOLD_ROWS, closed_windows.COUNT_ROWS)
    return blocks.mapInArrow(count, "counts binary")


def _activity_rows(blocks: DataFrame) -> DataFrame:
    counts = "window_start long, term_type string, key string, mention_count long, unique_authors long, total_engagement double, financial_context_count long, cashtag_cooccurrence_count long"
    rows = blocks.mapInArrow(dealt.read_counts(1, m.ALL_TYPES), counts)
    day = F.when(F.col("window_start") != _NO_DAY, F.date_from_unix_date(F.col("window_start").cast("int")))
    return rows.select(F.col("key").alias("trend_term"), day.alias("run_date"), "mention_count", F.col("total_engagement").alias("engagement_score"))


def ingest_activity(posts: DataFrame, folder: str, term_types: tuple[str, ...] = m.ALL_TYPES) -> None:
    """Add the daily activity of newly arrived posts to a table, once per post file.

    Each micro-batch owns one part and overwrites it, so a batch repeated after a failure replaces its
    own rows and counts nothing twice. Parts of finished batches are merged, so a table of any number
    of batches has a few parts.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        activity = _activity_blocks(batch, term_types)
        activity.write.mode("overwrite").options(**closed_windows.SMALL_GROUPS).parquet(f"{folder}/activity/batch_id={batch_id}")
        merge_activity(batch.sparkSession, folder, batch_id - 1)

    query = (
        posts.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _merged_until(spark: SparkSession, folder: str) -> int:
    """The last batch of the merged part; a part whose writing broke off doesn't count."""
    found = numbered_folders(spark, f"{folder}/merged", "until")
    return max((n for n in found if folder_exists(spark, f"{folder}/merged/until={n}/_SUCCESS")), default=-1)


def merge_activity(spark: SparkSession, folder: str, finished: int, most: int = MAX_PARTS) -> None:
    """Merge the parts of the batches up to ``finished`` if there are many.

    The merged part is complete before any of its parts is deleted, and readers skip parts that it
    holds, so an interruption at any moment changes no count; what was left is deleted the next time.
    """
    until = _merged_until(spark, folder)
    parts = [n for n in numbered_folders(spark, f"{folder}/activity", "batch_id") if n <= finished]
    if len(parts) >= most and parts[-1] > until:
        _activity_until(spark, folder, finished).write.mode("overwrite").parquet(f"{folder}/merged/until={finished}")
        until = finished
    for n in parts:
        if n <= until:
            delete_folder(spark, f"{folder}/activity/batch_id={n}")
    for n in numbered_folders(spark, f"{folder}/merged", "until"):
        if n < until:
            delete_folder(spark, f"{folder}/merged/until={n}")


def _activity_until(spark: SparkSession, folder: str, last: int | None = None) -> DataFrame:
    until = _merged_until(spark, folder)
    numbers = numbered_folders(spark, f"{folder}/activity", "batch_id")
    paths = [f"{folder}/activity/batch_id={n}" for n in numbers if n > until and (last is None or n <= last)]
    paths += [f"{folder}/merged/until={until}"] if until >= 0 else []
    if not paths:
        return spark.createDataFrame([], _ACTIVITY)
    stored = spark.read.schema(_PART).parquet(*paths)
    parts = stored.where("counts IS NULL").drop("counts").unionByName(_activity_rows(stored.where("counts IS NOT NULL").select("counts")))
    if len(paths) == 1:  # a part has one row for each term and day
        return parts
    return parts.groupBy("trend_term", "run_date").agg(
        F.sum("mention_count").alias("mention_count"),
        (F.sum(F.round(F.col("engagement_score") * 10).cast("bigint")) / 10.0).alias("engagement_score"),
    )


def ingested_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Daily activity over all micro-batches so far."""
    return _activity_until(spark, folder)


def deduplicated(posts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Posts without repeats of an id inside the watermark."""
    once = _event_time(posts, delay).dropDuplicatesWithinWatermark(["id"])
    return once.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def daily_counts(
    posts: DataFrame, folder: str, delay: dt.timedelta = dt.timedelta(days=1), term_types: tuple[str, ...] = m.ALL_TYPES
) -> DataFrame:
    """Mentions and authors per term and day, counted when the day is closed; later posts are kept aside.

    Takes in what is available; with the same folder a later call goes on.
    """
    counts = closed_windows.run_closed(posts, folder, Windows(delay=delay), term_types)
    return counts.select(
        F.to_date("window_start").alias("run_date"), "term_type", "key", "mention_count", "unique_authors", "total_engagement"
    )


def sliding_scores(
    posts: DataFrame,
    folder: str,
    delay: dt.timedelta = dt.timedelta(days=1),
    width: dt.timedelta = dt.timedelta(hours=6),
    slide: dt.timedelta = dt.timedelta(hours=1),
    term_types: tuple[str, ...] = m.ALL_TYPES,
) -> DataFrame:
    """Velocity and composite score of each term per closed sliding window, as ``daily_counts``."""
    counts = closed_windows.run_closed(posts, folder, Windows(width, slide, delay), term_types)
    end = F.col("window_start") + F.lit(width)
    return m.with_scores(counts).select(
        "window_start",
        end.alias("window_end"),
        "term_type",
        "key",
        "mention_count",
        "unique_authors",
        "total_engagement",
        "velocity_score",
        "composite_score",
    )


def hottest_per_window(scored: DataFrame, k: int = 10) -> DataFrame:
    """The best-scored terms of each closed window, from the table of ``sliding_scores``.

    Ranking alone would sort every row in its task. The terms of a window are dealt by hash to more lots than k first: no term below
    the k-th best of the best scores of the lots is among the k best, and is left out as it is read.
    """
    lot = F.pmod(F.xxhash64("term_type", "key"), F.lit(8 * k))
    tops = scored.groupBy("window_start", lot.alias("lot")).agg(F.max("composite_score").alias("top"))
    of_lots = Window.partitionBy("window_start").orderBy(F.desc("top"), "lot")
    bounds = tops.withColumn("place", F.row_number().over(of_lots)).where(F.col("place") == k).select(F.col("window_start").alias("_window"), F.col("top").alias("_top"))
    # One row for each window, whose number does not grow with the posts.
    bounded = scored.join(F.broadcast(bounds), F.col("window_start").eqNullSafe(F.col("_window")), "left")
    few = bounded.where(F.col("_top").isNull() | (F.col("composite_score") >= F.col("_top"))).drop("_window", "_top")
    best = Window.partitionBy("window_start").orderBy(F.desc("composite_score"), "term_type", "key")
    ranked = few.withColumn("window_rank", F.row_number().over(best))
    return ranked.where(F.col("window_rank") <= k)


def stream_engagement(posts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Posts and engagement per topic and hour of a post stream."""
    tenths = scoring.engagement_tenths(F.col("likes"), F.col("retweets"), F.col("replies"))
    return (
        _event_time(posts, delay)
        .groupBy(F.window("created_at", "1 hour").alias("w"), "topic")
        .agg(F.count(F.lit(1)).alias("n_posts"), F.sum(tenths).alias("tenths"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            "topic",
            "n_posts",
            (F.col("tenths") / 10.0).alias("engagement"),
        )
    )
