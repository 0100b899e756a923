"""Exact top-k by inner product with sorted lists read in sequence (no random access).

Each component of a block of candidates is a list in order of value. For a query, the lists are
read from the end where they contribute most. What has been read of a candidate bounds its score
from below and above; candidates whose upper bound is below the k-th best lower bound are dropped,
and when few are left their scores are resolved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.common import ship


def whole(embedding, scale: int = 1024):
    """floor(scale * x) of each component, or null where the vector takes no part."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    values = F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return F.when(embedding.isNotNull() & ~F.coalesce(bad, F.lit(False)), values)


#: Queries whose bounds are kept at once, and the part of each list that is read first.
QUERY_BATCH, FIRST_PART = 128, 8


def block_top(values: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int):
    """(query number, row, score) of the best k rows of a block for each query, ties to smaller ids.

    Rows with the query's id take no part. All queries read a list to the same depth, from its greatest
    value on or from its least, so the bounds of all rows for many queries are two products of matrices.
    """
    n, dims = values.shape
    exact = np.abs(values).max(initial=0) * np.abs(queries).max(initial=0) * max(dims, 1) < 2**52
    kind = np.float64 if exact else np.int64
    values, queries = values.astype(kind), queries.astype(kind)
    none = -np.inf if exact else np.iinfo(np.int64).min
    order = np.argsort(values, axis=0, kind="stable")
    ranked = np.take_along_axis(values, order, axis=0)
    rank = np.empty((n, dims), np.int32)
    np.put_along_axis(rank, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
    out = []
    for low in range(0, len(queries), QUERY_BATCH):
        some, own = queries[low : low + QUERY_BATCH], query_ids[low : low + QUERY_BATCH]
        signed = np.hstack([np.maximum(some, 0), np.minimum(some, 0)])  # lists read downwards, upwards
        rows = np.arange(n)
        live = own[:, None] != ids[None, :]
        depth = max(64, n // FIRST_PART)
        while len(rows) > 4 * k and depth < n:
            v, r = values[rows], rank[rows]
            down, up = r >= n - depth, r < depth  # what is read of each row
            least = np.hstack([np.where(down, v, ranked[0]), np.where(up, v, ranked[-1])])
            most = np.hstack([np.where(down, v, ranked[n - depth]), np.where(up, v, ranked[depth - 1])])
            lower, upper = signed @ least.T, signed @ most.T
            lower[~live] = none
            bar = np.partition(lower, len(rows) - k, axis=1)[:, len(rows) - k, None]
            live &= upper >= bar
            kept = live.any(axis=0)
            rows, live = rows[kept], live[:, kept]
            depth *= 4
        scores = some @ values[rows].T
        scores[~live] = none
        for number, (mine, score) in enumerate(zip(live, scores)):
            bar = np.partition(score, len(rows) - k)[len(rows) - k] if len(rows) > k else none
            found = np.flatnonzero(mine & (score >= bar))
            found = found[np.lexsort((ids[rows[found]], -score[found]))[:k]]
            out += [(low + number, int(rows[j]), int(score[j])) for j in found]
    return out


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "vector",
    candidate_block: int = 16_384,
    query_block: int = 1024,
) -> DataFrame:
    """query_id, rank, vec_id and score: the k best candidates of every query, ties to smaller ids.

    Both tables hold an id and an array of longs (see `whole`); null vectors and ids take no part,
    nor do candidates with the query's id or another number of components. Candidates that share
    an id with each other, but not with the query, are all kept; of several queries with one id
    the one with the least vector counts. Fewer candidates give fewer rows; an empty table on
    either side gives an empty result.

    Candidates and queries are cut into blocks of bounded size by their place in the table, which
    no key can make uneven; each pair of blocks is one group of work, which returns at most k rows
    for each query.
    """
    spark = vectors.sparkSession
    c = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    q = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    q = q.groupBy("id").agg(F.min("v").alias("v"))
    n_c, n_q = -(-c.count() // candidate_block), -(-q.count() // query_block)
    schema = "query_id long, vec_id long, score long"
    if not n_c or not n_q:
        return spark.createDataFrame([], f"{schema}, rank int").select("query_id", "rank", "vec_id", "score")
    place = F.monotonically_increasing_id()
    c = c.withColumn("cb", F.pmod(place, F.lit(n_c)).cast("int")).withColumn("dims", F.size("v"))
    c = c.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    q = q.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_q)).cast("int")).withColumn("dims", F.size("v"))
    q = q.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))

    def matrix(t: pa.Table) -> np.ndarray:
        flat = t.column("v").combine_chunks()
        return np.asarray(flat.flatten()).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 0))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, query_ids = np.asarray(left.column("id")), np.asarray(right.column("id"))
            found = block_top(matrix(left), ids, matrix(right), query_ids, k)
            rows = [(int(query_ids[a]), int(ids[b]), s) for a, b, s in found]
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score"])

    ship(spark)
    keys = ["cb", "qb", "dims"]
    found = c.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(run, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
    WHERE q.vec_id % 100 = 0
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
