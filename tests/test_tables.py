from __future__ import annotations

import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from trendloom.session import folder_exists, work_folder, written
from trendloom.sources import tables

HISTORY = "trend_term STRING, run_date DATE, mention_count INT, engagement_score DOUBLE"


def history(spark, *rows):
    return spark.createDataFrame([(t, dt.date(2024, 1, d), n, 1.0) for t, d, n in rows], HISTORY)


def stored(spark, path):
    return {(r.trend_term, r.run_date.day): r.mention_count for r in tables.read_trend_history(spark, path).collect()}


def test_upsert_replaces_by_key_and_leaves_other_days_alone(spark):
    path = work_folder(spark, "t")
    tables.store_trend_history(history(spark, ("a", 1, 1), ("b", 1, 1), ("a", 2, 1)), path)
    untouched = {p: p.stat().st_mtime_ns for p in Path(path).glob("run_date=2024-01-02/*.parquet")}
    change = history(spark, ("a", 1, 7), ("c", 1, 3), ("a", 3, 2))
    for _ in range(2):  # a repeated write changes nothing
        tables.store_trend_history(change, path)
        assert stored(spark, path) == {("a", 1): 7, ("b", 1): 1, ("c", 1): 3, ("a", 2): 1, ("a", 3): 2}
    assert {p: p.stat().st_mtime_ns for p in Path(path).glob("run_date=2024-01-02/*.parquet")} == untouched


def test_memory_upsert_keeps_first_creation(spark):
    path = work_folder(spark, "m")
    schema = "id STRING, date DATE, summary STRING, created_at TIMESTAMP_NTZ"
    day, early, late = dt.date(2024, 1, 5), dt.datetime(2024, 1, 5, 8), dt.datetime(2024, 1, 5, 20)
    tables.store_memories(spark.createDataFrame([("m1", day, "old", early), ("m2", day, "x", early)], schema), path)
    tables.store_memories(spark.createDataFrame([("m1", day, "new", late)], schema), path)
    got = {r.id: (r.summary, r.created_at) for r in tables.read_memories(spark, path).collect()}
    assert got == {"m1": ("new", early), "m2": ("x", early)}


def test_latest_versions_with_many_copies_of_one_key(spark):
    old = spark.range(5000).select(F.lit("hot").alias("k"), F.col("id").cast("int").alias("v"))
    new = spark.createDataFrame([("hot", -1), ("cold", 2)], "k STRING, v INT")
    rows = {r.k: r.v for r in tables.latest_versions(old, new, ["k"]).collect()}
    assert rows == {"hot": -1, "cold": 2}


def test_digests_append(spark):
    path = work_folder(spark, "d")
    schema = (
        "run_date DATE, trends ARRAY<STRING>, tweet_count INT, digest_text STRING, signal_strength STRING, "
        "top_engagement DOUBLE, notable BOOLEAN, created_at TIMESTAMP_NTZ"
    )
    for d in (1, 2):
        row = (dt.date(2024, 1, d), ["$A", "b"], 5, "text", "low", 1.5, False, dt.datetime(2024, 1, d))
        tables.store_digests(spark.createDataFrame([row], schema), path)
    rows = tables.read_digests(spark, path).orderBy("run_date").collect()
    assert [(r.run_date.day, r.trends) for r in rows] == [(1, ["$A", "b"]), (2, ["$A", "b"])]
    assert len({r.id for r in rows}) == 2


def test_list_codec(spark):
    df = spark.createDataFrame([(["a", 'q"x'],), (None,), ([],)], "v ARRAY<STRING>")
    text = tables.encode_lists(df, "v")
    assert [r.v for r in text.collect()] == ['["a","q\\"x"]', None, "[]"]
    assert [r.v for r in tables.decode_lists(text, "v").collect()] == [["a", 'q"x'], None, []]


def test_written_cuts_the_plan(spark):
    df = written(spark.range(10).withColumn("x", F.col("id") * 2), "w")
    assert "Range" not in df._jdf.queryExecution().toString()
    assert df.count() == 10


def test_posts_table_prunes_days_and_topics(spark):
    from trendloom import schemas

    path = work_folder(spark, "p")
    rows = [
        (i, "x", "u", "U", dt.datetime(2024, 1, 1 + i % 3), 1, 2, 3, None, "en", False, ["a"], f"t{i % 2}") for i in range(30)
    ]
    tables.store_posts(spark.createDataFrame(rows, schemas.POST + ", topic STRING"), path)
    table = tables.read_posts(spark, path)
    assert table.count() == 30
    some = table.where("run_date = DATE '2024-01-02' AND topic = 't1'")
    assert some.count() == 5
    assert "PartitionFilters: [isnotnull(run_date" in some._jdf.queryExecution().toString()


def test_newest_version_stays_in_any_order(spark):
    import itertools

    old = spark.createDataFrame([("k", 0, "old")], "k STRING, v INT, text STRING")
    for order in itertools.permutations([(1, "one"), (2, "two"), (3, "three")]):
        new = spark.createDataFrame([("k", *x) for x in order], "k STRING, v INT, text STRING")
        assert tables.latest_versions(old, new, ["k"], version="v").first().text == "three"


def test_one_row_per_memory_whatever_its_date(spark):
    path = work_folder(spark, "m")
    schema = "id STRING, date DATE, summary STRING, created_at TIMESTAMP_NTZ"
    for month in (1, 2, 3):
        row = ("x", dt.date(2024, month, 5), f"text {month}", dt.datetime(2024, month, 5))
        day = (f"memory_2024{month:02d}05", dt.date(2024, month, 5), "day", dt.datetime(2024, month, 5))
        tables.store_memories(spark.createDataFrame([row, day], schema), path)
    got = {r.id: r for r in tables.read_memories(spark, path).collect()}
    assert len(got) == tables.read_memories(spark, path).count() == 4
    assert (got["x"].summary, got["x"].created_at) == ("text 3", dt.datetime(2024, 1, 5))
    one = tables.read_memories(spark, path, "memory_20240205")
    assert one.first().date == dt.date(2024, 2, 5) and one.count() == 1
    assert "PartitionFilters: [isnotnull(part" in one._jdf.queryExecution().toString()


def test_interrupted_replacement_is_finished(spark, monkeypatch):
    path = work_folder(spark, "t")
    tables.store_trend_history(history(spark, ("a", 1, 1), ("a", 2, 1)), path)
    replace = tables._replace_partitions

    def interrupted(spark, merged, path, partition):
        for file in Path(path).glob("run_date=2024-01-01/*"):  # deleted, but not yet written anew
            file.unlink()
        raise KeyboardInterrupt

    monkeypatch.setattr(tables, "_replace_partitions", interrupted)
    try:
        tables.store_trend_history(history(spark, ("b", 1, 5)), path)
    except KeyboardInterrupt:
        pass
    assert stored(spark, path) == {("a", 2): 1}
    monkeypatch.setattr(tables, "_replace_partitions", replace)
    tables.store_trend_history(history(spark, ("c", 3, 9)), path)
    assert stored(spark, path) == {("a", 1): 1, ("b", 1): 5, ("a", 2): 1, ("c", 3): 9}
    assert not folder_exists(spark, f"{path}/_merged")


def test_two_runs_of_a_day_have_two_ids_and_months_are_pruned(spark):
    path = work_folder(spark, "d")
    schema = (
        "run_date DATE, trends ARRAY<STRING>, tweet_count INT, digest_text STRING, signal_strength STRING, "
        "top_engagement DOUBLE, notable BOOLEAN, created_at TIMESTAMP_NTZ"
    )
    for month, hour in ((1, 8), (1, 20), (2, 8), (3, 8)):
        row = (dt.date(2024, month, 5), ["a"], 5, "t", "low", 1.5, False, dt.datetime(2024, month, 5, hour))
        tables.store_digests(spark.createDataFrame([row], schema), path)
    assert len({r.id for r in tables.read_digests(spark, path).collect()}) == 4
    some = tables.read_digests(spark, path, dt.date(2024, 1, 1), dt.date(2024, 2, 5))
    assert some.count() == 3
    assert "PartitionFilters: [isnotnull(month" in some._jdf.queryExecution().toString()
