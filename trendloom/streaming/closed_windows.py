"""Windows of a post stream, each counted once, when the watermark has passed its end.

Arriving posts are stored as they are, by micro-batch and day; there is no state per term. When the
watermark passes the end of a window, the micro-batch that moved it counts the window from the stored
posts like a table, with exact authors. What a micro-batch has done is written to a ledger last, so a
batch that is repeated after a failure replaces its own rows, and one that is in the ledger is not
counted again. Days that no open window needs are deleted; posts too late for every window are kept.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions.text import DEFAULT_RULES
from trendloom.operators import dealt
from trendloom.operators import mentions as m
from trendloom.session import GATHER_BYTES, delete_folder, folder_exists, tasks_for

_SECOND = 1_000_000
_DAY = 86_400 * _SECOND
#: Blocks of counts are large rows, and a reader takes all rows of a row group at once.
SMALL_GROUPS = {"parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 8}
_LEDGER = "batch long, top long, passed long"
#: Before every watermark.
_NEVER = -(1 << 62)


@dataclass(frozen=True)
class Windows:
    """Width and slide of windows, which divide a day and begin at midnight UTC, and the delay of the
    watermark behind the latest post."""

    width: dt.timedelta = dt.timedelta(days=1)
    slide: dt.timedelta = dt.timedelta(days=1)
    delay: dt.timedelta = dt.timedelta(days=1)


def _micros(span: dt.timedelta) -> int:
    return span // dt.timedelta(microseconds=1)


def _at(micros: Column) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def _pane(windows: Windows) -> Column:
    """Where the last window that a post falls into begins."""
    slide = _micros(windows.slide)
    return F.floor(F.unix_micros(F.col("created_at").cast("timestamp")) / F.lit(slide)) * slide


#: Mentions in windows that are grouped at once in a task, and the most rows of counts in a block of them.
FOLD_ROWS, COUNT_ROWS = 2_000_000, 40_000


def count_terms(posts: DataFrame, windows: Windows, before: int, passed: int, term_types: tuple[str, ...]) -> DataFrame:
    """Counters with exact authors per term and window whose end lies in (before, passed], as blocks for ``_counts``.

    Terms are dealt to tasks as numbers and never are a row for each mention and window; nor are equal counts of windows in a row.
    """
    width, slide = _micros(windows.width), _micros(windows.slide)
    cores = posts.sparkSession.sparkContext.defaultParallelism
    tasks, groups = m.tasks_and_groups(tasks_for(posts, GATHER_BYTES) or cores, cores)
    groups *= width // slide
    facts = {"username": F.col("username"), "time": F.unix_micros(F.col("created_at").cast("timestamp")), "marks": m.post_marks()}
    blocks = m.term_blocks(posts, tasks, groups, term_types, DEFAULT_RULES, facts)
    return blocks.mapInArrow(dealt.window_counting(groups, width, slide, before, passed, FOLD_ROWS, COUNT_ROWS), "counts binary")


_COUNTS = (
    "window_start timestamp_ntz, term_type string, key string, mention_count long, unique_authors long, "
    "total_engagement double, financial_context_count long, cashtag_cooccurrence_count long"
)


def _counts(blocks: DataFrame, slide: int) -> DataFrame:
    rows = blocks.mapInArrow(dealt.read_counts(slide, m.ALL_TYPES), _COUNTS.replace("window_start timestamp_ntz", "window_start long"))
    return rows.withColumn("window_start", _at(F.col("window_start")))


def _ledger(spark: SparkSession, folder: str) -> list[tuple[int, int, int]]:
    if not folder_exists(spark, f"{folder}/ledger"):
        return []
    return sorted(tuple(r) for r in spark.read.schema(_LEDGER).parquet(f"{folder}/ledger/*").collect())


def _drop_days(spark: SparkSession, folder: str, last_start: int) -> None:
    """Delete the stored days that begin at or before a moment."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/arrivals/batch=*/late=false/day=*")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.globStatus(path) or []:
        if int(status.getPath().getName().split("=")[1]) <= last_start:
            system.delete(status.getPath(), True)


def _arrivals(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch long, late boolean, day long").parquet(f"{folder}/arrivals")


def _ddl(posts: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in posts.schema.fields)


def run_closed(
    posts: DataFrame,
    folder: str,
    windows: Windows = Windows(),
    term_types: tuple[str, ...] = m.ALL_TYPES,
    after_step: Callable[[str, int], None] = lambda step, batch: None,
) -> DataFrame:
    """Take in everything available and return the counts of all windows closed so far.

    A later call with the same folder goes on where this one stopped. ``after_step`` is called when a
    micro-batch has stored its posts, has counted, and stands in the ledger.
    """
    width, slide = _micros(windows.width), _micros(windows.slide)
    schema = _ddl(posts)

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        entries = _ledger(spark, folder)
        if any(entry[0] == number for entry in entries):
            return
        _, top, before = max((e for e in entries if e[0] < number), default=(-1, _NEVER, _NEVER))
        stored = f"{folder}/arrivals/batch={number}"
        (
            batch.where(F.col("created_at").isNotNull())
            .withColumn("late", _pane(windows) + width <= before)
            .withColumn("day", F.floor(_pane(windows) / F.lit(_DAY)) * _DAY)
            .write.mode("overwrite").option("compression", "zstd").partitionBy("late", "day").parquet(stored)
        )
        after_step("stored", number)
        arrived = _arrivals(spark, folder, schema)
        latest = F.max(F.unix_micros(F.col("created_at").cast("timestamp")))
        newest = arrived.where((F.col("batch") == number)).agg(latest).first()[0]
        top = max(top, newest if newest is not None else _NEVER)
        passed = max(before, top - _micros(windows.delay)) if top > _NEVER else before
        if passed > before:
            open_rows = arrived.where(~F.col("late") & (F.col("batch") <= number)).where(_pane(windows) + width > before)
            due = open_rows.where(_pane(windows) + slide <= passed).drop("batch", "late", "day")
            counts = count_terms(due, windows, before, passed, term_types)
            counts.write.mode("overwrite").options(**SMALL_GROUPS).parquet(f"{folder}/blocks/batch={number}")
        after_step("counted", number)
        entry = spark.createDataFrame([(number, top, passed)], _LEDGER)
        entry.coalesce(1).write.mode("overwrite").parquet(f"{folder}/ledger/{number}")
        after_step("entered", number)
        _drop_days(spark, folder, passed - width + slide - _DAY)
        for old, _, _ in entries[:-1]:
            delete_folder(spark, f"{folder}/ledger/{old}")

    stream = posts.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/state")
    stream.trigger(availableNow=True).start().awaitTermination()
    return closed_counts(posts.sparkSession, folder, windows)


def closed_counts(spark: SparkSession, folder: str, windows: Windows = Windows()) -> DataFrame:
    """The counts of all windows closed so far, of every run that used the folder, for windows with that slide."""
    parts = []
    if folder_exists(spark, f"{folder}/blocks"):
        blocks = spark.read.schema("counts binary, batch long").parquet(f"{folder}/blocks")
        parts.append(_counts(blocks.select("counts"), _micros(windows.slide)))
    if folder_exists(spark, f"{folder}/counts"):  # plain rows, from before counts were kept in blocks
        parts.append(spark.read.schema(f"{_COUNTS}, batch long").parquet(f"{folder}/counts").drop("batch"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _COUNTS)


def late_posts(spark: SparkSession, folder: str, posts: DataFrame) -> DataFrame:
    """The posts, with the columns of ``posts``, that came too late for every window they belong to."""
    if not folder_exists(spark, f"{folder}/arrivals"):
        return spark.createDataFrame([], posts.schema)
    return _arrivals(spark, folder, _ddl(posts)).where("late").drop("batch", "late", "day")
