from __future__ import annotations

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.compare import compare, connect
from tests.conftest import SF_SMALL

from trendloom.llm import queries, topk, vectors


def table():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 8))
    rows = []
    for i in range(240):
        v = base[rng.integers(12)] + rng.normal(size=8) * rng.choice([0.05, 0.2, 0.4, 1])
        rows.append((i, v.tolist(), int(rng.integers(0, 3))))
    rows += [(i, rows[7][1], rows[7][2]) for i in range(400, 430)]
    one, nan = [1.0] * 7, float("nan")
    return rows + [
        (500, None, 1), (501, [0.0] * 8, 1), (502, [nan, *one], 1), (503, [None, *one], 1), (504, base[0].tolist(), None),
        (None, base[0].tolist(), 1), (505, [1.0, 2.0], 1), (506, [1.0, 2.0], 1), (7, rows[7][1], rows[7][2]), (507, [], 1),
        (508, [float("inf"), *one], 1),
    ]


ROWS = table()


def frame(spark):
    df = spark.createDataFrame(ROWS, "vec_id long, embedding array<float>, label int")
    return df.select("*", *(F.lit(1).alias(c) for c in ("links", "pair", "rep", "dims", "cell", "cb", "id")))


def finite(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def brute(least):
    n = len(ROWS)
    ok = [r[0] is not None and r[2] is not None and finite(r[1]) and any(r[1]) for r in ROWS]
    a = [np.array(np.array(r[1], np.float32), float) if o else None for r, o in zip(ROWS, ok)]
    parent, counts = list(range(n)), [0] * n

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            if ok[i] and ok[j] and ROWS[i][2] == ROWS[j][2] and len(a[i]) == len(a[j]):
                if (a[i] * a[j]).sum() / (np.sqrt((a[i] * a[i]).sum()) * np.sqrt((a[j] * a[j]).sum())) >= least:
                    counts[i] += 1
                    counts[j] += 1
                    parent[root(i)] = root(j)
    smallest: dict[int, int] = {}
    for i in range(n):
        if ok[i]:
            smallest[root(i)] = min(smallest.get(root(i), 1 << 60), ROWS[i][0])
    out = []
    for i, r in enumerate(ROWS):
        component = smallest[root(i)] if ok[i] else r[0]
        out.append((r[0], counts[i], component, r[0] is None or component == r[0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limits", [{}, {"block": 20, "most_centers": 6}, {"block": 7, "most_centers": 1}])
def test_near_vectors(spark, limits):
    got = sorted((tuple(r) for r in vectors.near_vectors(frame(spark), **limits).collect()), key=repr)
    want = brute(0.93)
    assert sum(r[1] for r in want) > 500
    assert got == want


def test_an_id_on_several_vectors(spark):
    """Rows of one id have the links of their own vector, in their own label."""
    a, b, far = [1.0, 0.0], [0.99, 0.05], [0.0, 1.0]
    rows = [(5, a, 1), (7, b, 1), (5, far, 1), (8, [0.01, 1.0], 1), (9, [0.02, 1.0], 1), (5, a, 2), (6, b, 2), (3, b, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in vectors.near_vectors(df).collect())
    assert got == [(3, 2, 3, True), (5, 1, 5, True), (5, 2, 3, False), (5, 2, 5, True), (6, 2, 3, False), (7, 1, 5, False), (8, 2, 5, False), (9, 2, 5, False)]


@pytest.mark.parametrize("kind,labels", [("string", ["x", "x", "1"]), ("double", [1.2, 1.2, 1.7])])
def test_labels_of_other_types(spark, kind, labels):
    rows = [(i, [1.0, 0.0], label) for i, label in enumerate(labels)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")
    assert sorted(tuple(r) for r in vectors.near_vectors(df).collect()) == [(0, 1, 0, True), (1, 1, 0, False), (2, 0, 2, True)]


def test_no_vectors(spark):
    assert vectors.near_vectors(frame(spark).limit(0)).count() == 0


def test_cover_tree_holds_its_members():
    rng = np.random.default_rng(3)
    u = rng.normal(size=(500, 4))
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    todo = [vectors.build(u, np.arange(500))]
    assert len(todo[0].children) > 1
    while todo:
        node = todo.pop()
        gap = np.sqrt(np.maximum(0, 2 - 2 * u[node.members] @ u[node.center]))
        assert gap.max() <= node.radius + 1e-7
        if node.children:
            assert sorted(np.concatenate([c.members for c in node.children])) == sorted(node.members)
            assert node.children[0].center == node.center
            assert max(c.radius for c in node.children) <= node.radius / 2 + 1e-7
            todo += node.children


def brute_top(k, every):
    whole = [(r[0], [math.floor(1024 * float(np.float32(x))) for x in r[1]]) for r in ROWS if r[0] is not None and r[1] is not None and (finite(r[1]) or not r[1])]
    asked: dict[int, list[int]] = {}
    for i, v in whole:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for i, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i and len(w) == len(v))[:k]
        out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"candidate_block": 60, "query_block": 7}])
def test_top_k(spark, limits):
    rows = frame(spark).select("vec_id", topk.whole(F.col("embedding")).alias("vector"))
    got = sorted(tuple(r) for r in topk.top_k(rows, rows.where("vec_id % 10 = 0"), **limits).collect())
    assert got == brute_top(10, 10)
    assert topk.top_k(rows, rows.limit(0)).count() == 0
    assert topk.top_k(rows.limit(0), rows).count() == 0


def test_bounds_stop_before_the_lists_end():
    rng = np.random.default_rng(2)
    values = rng.integers(-50, 50, (3000, 6))
    values[:40] += 1000
    query = np.array([[7, 3, 5, 0, 2, 9]])
    got = topk.block_top(values, np.arange(3000), query, np.array([-1]), 10)
    scores = values @ query[0]
    best = np.lexsort((np.arange(3000), -scores))[:10]
    assert [g[1] for g in got] == best.tolist() and [g[2] for g in got] == scores[best].tolist()


def test_many_queries_cost_little_more_than_their_scores():
    rng = np.random.default_rng(3)
    values = rng.integers(-300, 300, (8192, 64))
    ids, queries = np.arange(8192), values[::64]

    def scored():
        out = []
        for number, q in enumerate(queries):
            scores = values @ q
            best = np.lexsort((ids, -scores))
            best = best[best != 64 * number][:10]
            out += [(number, int(row), int(scores[row])) for row in best]
        return out

    def seconds(run):
        start = time.perf_counter()
        made = run()
        return time.perf_counter() - start, made

    plain, bounded = ([seconds(run) for _ in range(3)] for run in (scored, lambda: topk.block_top(values, ids, queries, ids[::64], 10)))
    assert plain[0][1] == bounded[0][1]
    assert min(s for s, _ in bounded) < 2 * min(s for s, _ in plain)


@pytest.mark.parametrize("name", ["op2_cover_tree_duplicates", "op5_sorted_list_top_k"])
def test_query(spark, name):
    assert compare(queries.QUERIES[name](spark, SF_SMALL), connect(SF_SMALL), queries.ORACLES[name]) is None
