from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.operators import memory, nearest

SCHEMA = "id LONG, embedding ARRAY<FLOAT>"


def vectors(n, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, dim)).astype("float32")


def frame(spark, rows, parts=4):
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def as_queries(memories, ids):
    rows = memories.where(memories["id"].isin(ids))
    return rows.withColumnsRenamed({"id": "query_id", "embedding": "query_embedding"})


def by_loop(rows, ids, k, floor):
    unit = rows.astype("float64")
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    expected = set()
    for q in ids:
        scores = [(-round(float(unit[q] @ v), 12), i) for i, v in enumerate(unit) if i != q]
        best = sorted(s for s in scores if -s[0] >= floor)[:k]
        expected |= {(q, i, rank) for rank, (_, i) in enumerate(best, 1)}
    return expected


@pytest.mark.parametrize("part_rows", [4096, 7])
def test_search_equals_loop(spark, part_rows):
    rows = vectors(300)
    memories = frame(spark, rows)
    ids = list(range(0, 300, 13))
    hits = memory.search(memories, as_queries(memories, ids), k=4, min_similarity=0.5, part_rows=part_rows)
    got = {(r.query_id, r.id, r.match_rank) for r in hits.collect()}
    assert got == by_loop(rows, ids, 4, 0.5)


def test_copies_of_one_vector_stay_bounded_and_ordered(spark):
    rows = np.vstack([np.repeat(vectors(1), 200, axis=0), vectors(50, seed=2)])
    memories = frame(spark, rows)
    hits = memory.search(memories, as_queries(memories, [5]), k=3, min_similarity=0.9).collect()
    assert sorted((r.match_rank, r.id) for r in hits) == [(1, 0), (2, 1), (3, 2)]
    assert all(r.distance == pytest.approx(0, abs=1e-9) for r in hits)


def clustered(n, dim=8, groups=6, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    # A third of all rows lies around the first centre.
    group = np.where(rng.random(n) < 0.33, 0, rng.integers(0, groups, n))
    return (centres[group] + rng.normal(size=(n, dim)) * 0.05).astype("float32")


@pytest.mark.parametrize("floor", [-1.0, 0.0, 0.999])
def test_every_row_as_a_query(spark, floor):
    rows = clustered(240)
    rows[7] = rows[8] = 0
    rows[100:110] = rows[100]
    memories = frame(spark, rows)
    hits = memory.search(memories, as_queries(memories, list(range(240))), k=3, min_similarity=floor, part_rows=16)
    got = {(r.query_id, r.id, r.match_rank) for r in hits.collect()}
    safe = rows.astype("float64")
    norms = np.maximum(np.linalg.norm(safe, axis=1, keepdims=True), 1e-300)
    scores = np.round(safe / norms @ (safe / norms).T, 12)
    np.fill_diagonal(scores, -2)
    want = set()
    for q, row in enumerate(scores):
        best = sorted((-s, i) for i, s in enumerate(row) if s >= floor and i != q)[:3]
        want |= {(q, i, rank) for rank, (_, i) in enumerate(best, 1)}
    assert got == want


def test_far_parts_are_not_read(spark):
    """Queries of tight groups are routed to few of all parts once they have a bar."""
    rows = clustered(600)
    memories = frame(spark, rows)
    vectors = nearest._unit_rows(memories, "id", "embedding")
    measure = nearest._measure(nearest.pivots(vectors))
    members, parts = nearest._parted(nearest._placed(vectors, measure), 20)
    assert members.groupBy("part").count().agg({"count": "max"}).first()[0] <= 60
    asked = vectors.withColumn("bar", F.lit(0.99))
    routes = nearest._routed(asked, measure, parts, False, 0.5).count()
    assert routes < 600 * parts.salts.sum() / 3


def test_vectors_without_direction_match_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 0.0]), (4, [None, 1.0]), (5, []), (6, None), (7, [0.0, 0.0]), (8, [2.0, 0.0])]
    memories = spark.createDataFrame(rows, "id LONG, embedding ARRAY<DOUBLE>").selectExpr("*", "'x' AS part", "'y' AS bar")
    hits = memory.search(memories, as_queries(memories, list(range(9))), k=5, min_similarity=0.5).collect()
    assert {(r.query_id, r.id, r.similarity) for r in hits} == {(1, 8, 1.0), (8, 1, 1.0)}


def test_vectors_of_another_length_are_no_match(spark):
    memories = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0]), ("c", [1.0]), ("d", [])], "id STRING, embedding ARRAY<DOUBLE>")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id STRING, query_embedding ARRAY<DOUBLE>")
    assert [r.id for r in memory.search(memories, asked, k=5).collect()] == ["a"]


def test_search_without_queries_or_vectors(spark):
    memories = frame(spark, vectors(5))
    assert memory.search(memories, as_queries(memories, [99])).count() == 0
    empty = spark.createDataFrame([(1, None)], SCHEMA)
    assert memory.search(empty, as_queries(memories, [1]), min_similarity=0.0).count() == 0


def test_budget_prefers_strong(spark):
    rows = [(1, i, s) for i, s in enumerate([0.9, 0.8, 0.7, 0.65, 0.5])]
    rows += [(2, 10, 0.7), (2, 11, 0.61)]
    hits = spark.createDataFrame(rows, "query_id LONG, id LONG, similarity DOUBLE")
    got = {(r.query_id, r.budget_rank): (r.id, r.band) for r in memory.parallels_within_budget(hits).collect()}
    assert got == {
        (1, 1): (0, "strong"), (1, 2): (1, "strong"), (1, 3): (2, "moderate"),
        (2, 1): (10, "moderate"), (2, 2): (11, "moderate"),
    }


def digests(spark):
    rows = [
        (dt.date(2024, 1, 1), ["$NVDA"], "**Bottom Line:**\nchips and gpu shortage talk", "high", 5.0, True, 9),
        (dt.date(2024, 1, 2), ["Silver"], "**Bottom Line:**\ngpu shortage and chips again", "low", 5.0, False, 9),
        (dt.date(2024, 1, 3), ["Eggs"], "**Bottom Line:**\nfreight strike at the harbour", "low", 5.0, True, 9),
    ]
    return spark.createDataFrame(
        rows,
        "run_date DATE, trends ARRAY<STRING>, digest_text STRING, signal_strength STRING, "
        "top_engagement DOUBLE, notable BOOLEAN, tweet_count INT",
    )


def test_records_and_lookups(spark):
    records = memory.memory_records(digests(spark))
    assert memory.get_by_date(records, dt.date(2024, 1, 2)).first().id == "memory_20240102"
    assert [r.id for r in memory.get_notable(records, 1).collect()] == ["memory_20240103"]
    recent = memory.get_recent(records, dt.date(2024, 1, 3), days=1).collect()
    assert [r.id for r in recent] == ["memory_20240103", "memory_20240102"]
    assert memory.count(records).first().n_memories == 3


def test_embedded_days_with_common_words_are_closest(spark):
    records = memory.memory_records(digests(spark)).select("id", "summary")
    embedded = memory.embed(records, "summary", features=256).cache()
    norms = [np.linalg.norm(r.embedding) for r in embedded.collect()]
    assert norms == pytest.approx([1, 1, 1])
    asked = embedded.where("id = 'memory_20240101'").selectExpr("id AS query_id", "embedding AS query_embedding")
    best = memory.search(embedded, asked, k=1, min_similarity=0.0).first()
    assert best.id == "memory_20240102"


def test_recent_memories_end_at_the_as_of_day(spark):
    records = memory.memory_records(digests(spark))
    assert [r.id for r in memory.get_recent(records, dt.date(2024, 1, 2), days=1).collect()] == ["memory_20240102", "memory_20240101"]
