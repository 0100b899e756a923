"""Terms are dealt to tasks in few bytes, and counted from these as from rows."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.test_counted import SCHEMA
from trendloom.functions.text import DEFAULT_RULES
from trendloom.operators import dealt
from trendloom.operators import mentions as m
from trendloom.operators import phrases
from trendloom.plans import testdata as td
from trendloom.streaming import closed_windows as cw
from trendloom.streaming import posts_stream as ps


def test_numbers_and_texts_come_back():
    pack, unpack, texts, read_texts = dealt.packing()
    arrays = [np.array(a, np.int64) for a in ([], [7], [-1, 0, 1], [2**63 - 1, -(2**63), 5], range(70_000), [3] * 1000)]
    words = pa.array(["", "東京", "a b", "x" * 300])
    got = unpack(pack([*arrays, *texts(words), *texts(words.slice(1, 2)), *texts(words.slice(0, 0))]))
    assert all(a.tolist() == b.tolist() for a, b in zip(arrays, got))
    sizes_and_data = got[len(arrays) :]
    assert [read_texts(*sizes_and_data[k : k + 2]).to_pylist() for k in (0, 2, 4)] == [words.to_pylist(), words.to_pylist()[1:3], []]


def test_terms_take_fewer_bytes_than_rows(spark):
    """Mentions took about ten times the stored bytes of the posts on disk."""
    posts = td.derived(spark, SF_SMALL, "posts")
    facts = {"username": F.col("username"), "created_at": F.col("created_at"), "marks": m.post_marks()}
    blocks = m.term_blocks(posts, 8, 1, m.ALL_TYPES, DEFAULT_RULES, facts)
    taken = blocks.agg(F.sum(F.length("block"))).first()[0]
    assert taken < 2.5 * Path(SF_SMALL, "documents.parquet").stat().st_size
    assert taken < 7 * m.mentions(posts).count()


@pytest.mark.parametrize("groups", [1, 5])
def test_many_words_and_posts(spark, tmp_path, monkeypatch, groups):
    """Numbers of more than two bytes, authors without end, terms of every shape, and several groupings of a task."""
    rng = random.Random(3)
    pool = [f"wort{k:x}" for k in range(60_000)] + ["the", "of", "$x#", "#silver", "machine", "learning"] * 900
    rows = []
    for i in range(600):
        text = " ".join(rng.choice(pool) for _ in range(rng.choice([0, 3, 200])))
        time = None if i % 50 == 0 else dt.datetime(1969, 12, 31) + dt.timedelta(microseconds=rng.randrange(10**15))
        rows.append((i, text, None if i % 40 == 1 else f"u{rng.randrange(9**9)}", time, rng.choice([None, 0, -9, 2**31 - 1]), 1, 1, i % 9 == 0, rng.choice([None, [], ["Gold", None, "gold"]])))
    memory = spark.createDataFrame(rows, SCHEMA)
    memory.repartition(3).write.parquet(f"{tmp_path}/posts")
    stored = spark.read.schema(memory.schema).parquet(f"{tmp_path}/posts")
    monkeypatch.setattr(m, "tasks_and_groups", lambda *_: (3, groups))
    got, want = m.post_stats(stored), m.term_stats(m.mentions(memory))
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr) != []
    few = m.supported_post_stats(stored, min_mentions=2, min_authors=2)
    assert sorted(few.collect(), key=repr) == sorted(m.supported(want, 2, 2).collect(), key=repr) != []


@pytest.mark.parametrize("fold", [3, 2_000_000])
@pytest.mark.parametrize("hours", [1, 6, 24])
def test_windows_in_runs(spark, tmp_path, monkeypatch, fold, hours):
    """counts of windows from runs of equal ones are those that Spark makes of a row for each mention and window."""
    monkeypatch.setattr(cw, "FOLD_ROWS", fold)
    monkeypatch.setattr(cw, "COUNT_ROWS", 7 if fold == 3 else 40_000)
    rng = random.Random(hours)
    pool = ["gold", "silver", "the", "$TSLA", "rally", "东京", "c-d"]
    rows = []
    for i in range(150):
        words = " ".join(rng.choice(pool) for _ in range(rng.choice([0, 2, 6])))
        time = dt.datetime(2023, 12, 31, 20) + dt.timedelta(minutes=rng.randrange(60 * 70))
        rows.append((i, None if i % 31 == 0 else words, rng.choice(["u", "v", None]), time, rng.choice([None, 0, 4]), 1, 1, i % 9 == 0, rng.choice([None, ["Gold"]])))
    memory = spark.createDataFrame(rows, SCHEMA)
    memory.repartition(3).write.parquet(f"{tmp_path}/posts")
    windows = cw.Windows(dt.timedelta(hours=hours), dt.timedelta(hours=24 if hours == 24 else 1), dt.timedelta(hours=12))
    got = cw.run_closed(spark.readStream.schema(memory.schema).parquet(f"{tmp_path}/posts"), f"{tmp_path}/state", windows)
    starts = F.explode(F.sequence(F.lit(0), F.lit(0 if hours == 24 else hours - 1))).alias("back")
    slide = "day" if hours == 24 else "hour"
    each = m.mentions(memory).select("*", starts).withColumn("window_start", F.date_trunc(slide, "created_at").cast("timestamp_ntz") - F.expr("make_dt_interval(0, back)"))
    last = max(r[3] for r in rows) - dt.timedelta(hours=12)
    closed = each.where(F.col("window_start") + F.expr(f"make_dt_interval(0, {hours})") <= F.lit(last).cast("timestamp_ntz"))
    tag = F.col("term_type") == m.CASHTAG
    want = closed.groupBy("window_start", "term_type", "key").agg(
        F.count("*").alias("mention_count"), F.countDistinct("username").alias("unique_authors"), (F.sum("engagement_tenths") / 10.0).alias("total_engagement"),
        F.count_if(tag | F.col("has_context")).alias("financial_context_count"), F.count_if(~tag & F.col("has_cashtag")).alias("cashtag_cooccurrence_count"),
    )
    assert got.dtypes == want.dtypes
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr) != []


def test_stream_state_stays_small(spark, tmp_path):
    """kept counts of sliding windows took more than thirty times the stored bytes of the posts."""
    rows = ps.sliding_scores(td.post_stream(spark, SF_SMALL), f"{tmp_path}/state")
    assert rows.count() > 100_000
    kept = sum(p.stat().st_size for p in Path(f"{tmp_path}/state").rglob("*.parquet"))
    assert kept < 10 * Path(SF_SMALL, "documents.parquet").stat().st_size


def test_counts_from_before_are_read(spark, tmp_path):
    """State folders of earlier versions hold their counts as plain rows."""
    old = spark.createDataFrame([(dt.datetime(2024, 1, 1), "ngram", "gold", 3, 2, 1.5, 0, 0)], cw._COUNTS)
    old.write.parquet(f"{tmp_path}/counts/batch=0")
    assert cw.closed_counts(spark, str(tmp_path)).collect() == old.collect()


def test_hottest_terms_among_ties_and_unknown_scores(spark):
    """lots leave out no term that the ranking of all rows keeps."""
    rng = random.Random(5)
    score = lambda: rng.choice([0.0, 1.0, 1.5, float("nan"), None, rng.random()])
    rows = [(dt.datetime(2024, 1, 1 + k % 7), rng.choice(m.ALL_TYPES), f"k{k}", score()) for k in range(900)]
    rows += [(dt.datetime(2024, 2, 1), m.NGRAM, f"k{k}", None) for k in range(400)] + [(dt.datetime(2024, 2, 2), m.NGRAM, "alone", 1.0)]
    scored = spark.createDataFrame(rows, "window_start timestamp_ntz, term_type string, key string, composite_score double")
    best = Window.partitionBy("window_start").orderBy(F.desc("composite_score"), "term_type", "key")
    want = scored.withColumn("window_rank", F.row_number().over(best)).where("window_rank <= 10")
    got = ps.hottest_per_window(scored)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "_top" in got._jdf.queryExecution().optimizedPlan().toString()


def test_activity_of_odd_posts(spark, tmp_path):
    """terms that are one when $ and # are taken from their ends, whichever family they are of, with and without a time."""
    day = dt.datetime(2024, 1, 3, 23, 59)
    rows = [
        (1, "#silver $silver silver $silver# rally# $x rally#", "a", day, 1, 0, 0, False, ["Silver", "gold rally", "gold rally now"]),
        (2, "gold rally# now# gold $rally now", "a", None, 3, 0, 0, False, ["a b c d", "$$$$", None]),
        (3, "$NVDA nvda gold rally", None, dt.datetime(1969, 12, 31, 1), None, None, None, False, None),
        (4, None, "b", day, -2, -2, -2, False, ["gold  rally", "#silver"]),
        (5, "gold rally", "b", day, 5, 5, 5, True, ["gold"]),
    ]
    memory = spark.createDataFrame(rows, SCHEMA)
    memory.repartition(2).write.parquet(f"{tmp_path}/posts")
    ps.ingest_activity(spark.readStream.schema(memory.schema).parquet(f"{tmp_path}/posts"), f"{tmp_path}/state")
    got, want = ps.ingested_activity(spark, f"{tmp_path}/state"), m.daily_activity(m.mentions(memory))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) != []
    assert got.dtypes == want.dtypes
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_sieves_leave_out_no_phrase(spark, monkeypatch):
    """a sieve with few slots lets more through, and never less."""
    monkeypatch.setattr(phrases, "SIEVE_SLOTS", 1)
    posts = spark.range(300).select("id", F.concat_ws(" ", F.lit("the"), *(F.concat(F.lit(c), (F.col("id") % k).cast("string")) for c, k in zip("abcd", (7, 11, 13, 17)))).alias("text"))
    listed = posts.select(F.explode(F.array(*(F.substring_index("text", " ", n) for n in (1, 2, 3, 5)))).alias("phrase")).distinct()
    some = listed.where("size(split(phrase, ' ')) < 4")
    texts = {r.id: f" {r.text} " for r in posts.collect()}
    for sought in (listed, some):
        hits = phrases.phrase_hits(posts, sought)
        wanted = {(i, r.phrase) for i, t in texts.items() for r in sought.collect() if f" {r.phrase} " in t}
        assert sorted((r.id, r.phrase) for r in hits.collect()) == sorted(wanted)
    assert "BroadcastHashJoin" in hits._jdf.queryExecution().executedPlan().toString()


def test_first_posts_with_samples(spark, tmp_path):
    """ties, repeated and missing ids, missing times and texts; retweets have no terms, but share the ids of samples."""
    day = dt.datetime(2024, 1, 3)
    rows = [(i % 40 if i % 13 else None, None if i % 17 == 0 else f"gold rally $TSLA w{i % 9} silver", "a", None if i % 11 == 0 else day + dt.timedelta(days=i % 4), 1, 0, 0, i % 7 == 0, ["Gold"]) for i in range(90)]
    memory = spark.createDataFrame(rows, SCHEMA)
    memory.repartition(3).write.parquet(f"{tmp_path}/posts")
    stored = spark.read.schema(memory.schema).parquet(f"{tmp_path}/posts")
    got, want = m.first_post_samples(stored, 3, 12), m.first_post_samples(memory, 3, 12)
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) != []
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert m.first_post_samples(stored.where("id < 0")).collect() == []
