"""Exact cosine search of many query vectors among many others, as a join of blocks.

Vectors are dealt to cells around pivots and, by their angle to the pivot, to shells and parts of a
bounded number of rows. A part's shell bounds the cosine it can reach with a query, by the triangle
inequality of angles. A query first meets the part with the best bound; its k-th score there is the
bar that the bound of any other part has to reach. Parts and the queries routed to them are shuffled
together and sorted, so that a task holds one part while queries pass, in both of two passes.

The functions that run in tasks are local ones, so that workers need no copy of this package.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.session import discard, written

#: Pivots, and shells of a cell: at most PIVOTS vectors and, for each length of vectors, about
#: PIVOTS * SHELLS rows of bounds come to the driver, however many vectors there are.
PIVOTS, SHELLS = 64, 64
PART_ROWS = 4096
#: Queries that meet a part in one matrix product.
_STEP = 512
#: Angles are safe by this much (radians); a product's rounding is far below it.
_SLACK = 1e-6


@dataclass(frozen=True)
class Parts:
    """The bounds of every part: its cell, its angles to the pivot, and its first number and copies."""

    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    number: np.ndarray
    salts: np.ndarray


def _unit_rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key and its vector in doubles; null, empty and not wholly finite vectors have no cosine."""
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(usable)


def pivots(vectors: DataFrame, n: int = PIVOTS) -> list[list[float]]:
    """A bounded choice of vectors, the same in every run: the ones whose keys have the least hashes."""
    chosen = vectors.withColumn("h", F.xxhash64("key")).orderBy("h", "key").limit(n)
    return [r.v for r in chosen.select("v").collect()]


def _measure(centres: list[list[float]]):
    """(vectors of one length) -> unit vectors, cell and angle of each, and angles to all its cells.

    Cells are numbered by length of vector. Vectors of zeros, and those of a length without pivot,
    have a cell of their own whose angles bound nothing.
    """
    by_size: dict[int, np.ndarray] = {}
    for size in {len(c) for c in centres}:
        rows = np.unique(np.array([c for c in centres if len(c) == size]), axis=0)
        norms = np.linalg.norm(rows, axis=1)
        if (norms > 0).any():
            by_size[size] = rows[norms > 0] / norms[norms > 0, None]
    width = PIVOTS + 1

    def measure(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        size = rows.shape[1]
        norms = np.linalg.norm(rows, axis=1)
        unit = rows / np.maximum(norms, 1e-300)[:, None]
        centre = by_size.get(size)
        if centre is None:
            none = np.zeros(len(rows))
            return unit, np.full(len(rows), size * width + width - 1), none, np.zeros((len(rows), 0))
        angles = np.arccos(np.clip(unit @ centre.T, -1, 1))
        best = angles.argmin(axis=1)
        cell = np.where(norms > 0, size * width + best, size * width + width - 1)
        return unit, cell, np.where(norms > 0, angles[np.arange(len(rows)), best], 0.0), angles

    return measure


def _lists():
    """(column) -> places and vectors for each length in a column of lists; (matrix) -> such a column."""

    def by_length(column):
        lengths = column.value_lengths().to_numpy()
        for size in np.unique(lengths):
            places = np.flatnonzero(lengths == size)
            flat = column.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False)
            yield places, flat.reshape(len(places), int(size))

    def packed(rows):
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rows.ravel()))

    return by_length, packed


def _placed(vectors: DataFrame, measure) -> DataFrame:
    """Unit vectors with their cell and their angle to its pivot."""
    key_type = vectors.schema["key"].dataType.simpleString()
    by_length, packed = _lists()

    def run(batches):
        for batch in batches:
            for places, rows in by_length(batch.column("v")):
                unit, cell, angle, _ = measure(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(places)), packed(unit), pa.array(cell, pa.int64()), pa.array(angle)],
                    names=["key", "v", "cell", "angle"],
                )

    return vectors.mapInArrow(run, f"key {key_type}, v array<double>, cell long, angle double")


def _parted(placed: DataFrame, part_rows: int) -> tuple[DataFrame, Parts]:
    """Vectors with the number of their part, and the bounds of all parts."""
    cells = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high")
    )
    share = (F.col("angle") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-12))
    shells = F.least(F.ceil(F.col("rows") / part_rows), F.lit(SHELLS))
    shell = F.least(F.floor(share * shells), shells - 1).cast("long").alias("shell")
    shelled = placed.join(F.broadcast(cells), "cell").select("key", "v", "cell", "angle", shell)
    bounds = shelled.groupBy("cell", "shell").agg(
        F.count(F.lit(1)).alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high")
    )
    found = sorted(tuple(r) for r in bounds.collect())
    salts = [-(-rows // part_rows) for _, _, rows, _, _ in found]
    numbers = np.concatenate(([0], np.cumsum(salts)))[:-1].astype(np.int64)
    spark = placed.sparkSession
    listed = [(c, s, int(n), k) for (c, s, *_), n, k in zip(found, numbers, salts)]
    table = spark.createDataFrame(listed, "cell long, shell long, number long, salts int")
    numbered = shelled.join(F.broadcast(table), ["cell", "shell"])
    part = F.col("number") + F.pmod(F.xxhash64("key", "v"), F.col("salts").cast("long"))
    column = lambda i, kind: np.array([f[i] for f in found], kind)
    parts = Parts(column(0, np.int64), column(3, float), column(4, float), numbers, np.array(salts, np.int64))
    return numbered.select(part.alias("part"), "key", "v"), parts


def _routed(queries: DataFrame, measure, parts: Parts, first: bool, floor: float) -> DataFrame:
    """A row per query and part it has to meet: the part with the best bound, or all others that can
    reach its bar (column ``bar``; null where fewer than k were found)."""
    key_type = queries.schema["key"].dataType.simpleString()
    by_length, packed = _lists()
    cell, low, high, number, salts = parts.cell, parts.low, parts.high, parts.number, parts.salts
    width, slack = PIVOTS + 1, _SLACK

    def bounds(size, unit, angles):
        """The highest cosine each part allows each query; -2 for vectors of another length."""
        out = np.full((len(unit), len(cell)), -2.0)
        mine = np.flatnonzero(cell // width == size)
        for p in mine:
            column = cell[p] % width
            if column >= angles.shape[1]:
                out[:, p] = 1.0
                continue
            gap = np.maximum(np.maximum(angles[:, column] - high[p], low[p] - angles[:, column]) - slack, 0)
            out[:, p] = np.cos(np.minimum(gap, np.pi))
        out[np.ix_(~unit.any(axis=1), mine)] = 1.0
        return out, mine

    def run(batches):
        import zlib

        for batch in batches:
            bars = batch.column("bar").to_numpy(zero_copy_only=False)
            for places, rows in by_length(batch.column("v")):
                unit, own, _, angles = measure(rows)
                best, mine = bounds(rows.shape[1], unit, angles)
                if not len(mine):
                    continue
                keys = batch.column("key").take(pa.array(places))
                hashes = np.array([zlib.crc32(str(k).encode()) for k in keys.to_pylist()])
                nearest = cell == own[:, None]
                chosen = (best + nearest * 1e-3).argmax(axis=1)
                home = number[chosen] + hashes % salts[chosen]
                if first:
                    query, part = np.arange(len(unit)), home
                else:
                    bar = np.fmax(bars[places], floor) - 1e-9
                    query, at = np.nonzero(best >= bar[:, None])
                    many = salts[at]
                    query, part = np.repeat(query, many), np.repeat(number[at], many)
                    part += np.arange(len(part)) - np.repeat(np.cumsum(many) - many, many)
                    other = part != home[query]
                    query, part = query[other], part[other]
                for start in range(0, len(query), 4096):
                    q = query[start : start + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part[start : start + 4096], pa.int64()), keys.take(pa.array(q)), packed(unit[q])],
                        names=["part", "key", "v"],
                    )

    return queries.select("key", "v", "bar").mapInArrow(run, f"part long, key {key_type}, v array<double>")


def _met(members: DataFrame, routes: DataFrame, k: int, floor: float) -> DataFrame:
    """At most k hits per query and part, for every route. A part is held by one task at a time."""
    key_type = members.schema["key"].dataType.simpleString()
    step = _STEP
    streams = members.select("part", F.lit(0).alias("kind"), "key", "v").union(routes.select("part", F.lit(1), "key", "v"))
    ordered = streams.repartition("part").sortWithinPartitions("part", "kind")

    def run(batches):
        current, held_keys, held_rows, matrix, index, places = None, [], [], None, None, None
        for batch in batches:
            part, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for low, high in zip([0, *edges], [*edges, len(part)]):
                keys = batch.column(2).slice(low, high - low)
                flat = batch.column(3).slice(low, high - low).flatten().to_numpy(zero_copy_only=False)
                rows = flat.reshape(high - low, -1)
                if part[low] != current:
                    current, held_keys, held_rows, matrix = part[low], [], [], None
                if kind[low] == 0:
                    held_keys += keys.to_pylist()
                    held_rows.append(rows)
                    continue
                if not held_rows:
                    continue
                if matrix is None:
                    matrix = np.concatenate(held_rows)
                    order = pd.Series(held_keys).argsort(kind="stable").to_numpy()
                    matrix, index = matrix[order], [held_keys[i] for i in order]
                    places = {}
                    for i, key in enumerate(index):
                        places.setdefault(key, []).append(i)
                names = keys.to_pylist()
                for start in range(0, len(names), step):
                    # Rounded, so that the order of equal vectors does not depend on the part.
                    scores = np.round(rows[start : start + step] @ matrix.T, 12)
                    for q, name in enumerate(names[start : start + step]):
                        if name in places:
                            scores[q, places[name]] = -2.0
                    width = min(k, scores.shape[1])
                    kth = np.partition(scores, -width, axis=1)[:, -width]
                    q, m = np.nonzero(scores >= np.maximum(kth, floor)[:, None])
                    best = np.lexsort((m, -scores[q, m], q))
                    q, m = q[best], m[best]
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    q, m = q[place < k], m[place < k]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([names[start + i] for i in q], keys.type),
                            pa.array([index[i] for i in m], keys.type),
                            pa.array(scores[q, m], pa.float64()),
                        ],
                        names=["query_id", "id", "similarity"],
                    )

    return ordered.mapInArrow(run, f"query_id {key_type}, id {key_type}, similarity double")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, min_similarity: float = 0.6, part_rows: int = PART_ROWS
) -> DataFrame:
    """query_id, id, similarity, match_rank, distance: the k most similar other vectors of each query.

    ``vectors`` has id and embedding, ``queries`` a unique query_id, of the type of id, and
    query_embedding. Only similarities from min_similarity on count, rounded to twelve digits; equal
    ones go by id. Vectors of another length, null and empty ones, and those with null or infinite
    components match nothing. Neither vectors nor queries pass the driver, but for the pivots.
    """
    key_type = vectors.schema["id"].dataType
    asked = _unit_rows(queries.select(F.col("query_id").cast(key_type).alias("query_id"), "query_embedding"), "query_id", "query_embedding")
    asked, rows = written(asked, "asked-vectors"), written(_unit_rows(vectors, "id", "embedding"), "all-vectors")
    measure = _measure(pivots(rows))
    placed = written(_placed(rows, measure), "placed-vectors")
    discard(rows)
    members, parts = _parted(placed, part_rows)
    open_bar = asked.withColumn("bar", F.lit(None).cast("double"))
    near = written(_met(members, _routed(open_bar, measure, parts, True, min_similarity), k, min_similarity), "near-hits")
    full = near.groupBy(F.col("query_id").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least"))
    barred = asked.join(full.where(F.col("n") >= k).select("key", F.col("least").alias("bar")), "key", "left")
    far = _met(members, _routed(barred, measure, parts, False, min_similarity), k, min_similarity)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return (
        near.union(far)
        .withColumn("match_rank", F.row_number().over(best))
        .where(F.col("match_rank") <= k)
        .withColumn("distance", 1 - F.col("similarity"))
    )
