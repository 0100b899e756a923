"""Near-duplicate vectors by dual traversal of cover trees.

A tree's nodes hold vectors within a radius of one of them; radii halve from level to level, and a
node's own vector is the first of its children. Two nodes are compared only if the distance of
their vectors is at most the sum of their covering radii and the threshold, so that every pair of
vectors within the threshold is found and no other is returned.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import map_arrow, ship, written
from trendloom.llm.graph import components

_SLACK = 1e-7
#: Vectors a node may hold without being divided.
LEAF = 32


@dataclass
class Node:
    """A vector, the greatest distance of those below it, and either children or members."""

    center: int
    radius: float
    members: np.ndarray
    children: list[Node] = field(default_factory=list)


def _far(u: np.ndarray, center: int, members: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (u[members] @ u[center])))


def build(u: np.ndarray, members: np.ndarray, center: int | None = None, scale: float | None = None) -> Node:
    """The cover tree of some rows of unit vectors."""
    center = int(members[0]) if center is None else center
    distance = _far(u, center, members)
    node = Node(center, float(distance.max()), members)
    if len(members) <= LEAF or node.radius <= _SLACK:
        return node
    scale = node.radius / 2 if scale is None else min(scale, node.radius / 2)
    left, at, parts = members, center, []
    while len(left):
        near = _far(u, at, left) <= scale
        near[left == at] = True
        parts.append((at, left[near]))
        left = left[~near]
        at = int(left[0]) if len(left) else at
    if len(parts) == len(members) or len(parts) == 1:
        if len(parts) == 1:
            return build(u, members, center, scale / 2)
        node.children = [Node(c, 0.0, m) for c, m in parts]
        return node
    node.children = [build(u, m, c, scale / 2) for c, m in parts]
    return node


class Links:
    """Pairs within the threshold, kept as counts by row and as labels that join linked rows."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, least: float):
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.vectors, self.norms, self.weights, self.least = vectors, norms, weights, least
        self.unit = vectors / norms[:, None]
        self.reach = np.sqrt(2 - 2 * least)
        self.counts = np.zeros(len(vectors), np.int64)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """Every pair of a row of a and a row of b; of one list with itself, each pair once."""
        i, j = np.nonzero(self.unit[a] @ self.unit[b].T >= self.least - 1e-9)
        if same:
            i, j = i[i < j], j[i < j]
        self._count(a[i], b[j])

    def traverse(self, a: Node, b: Node) -> None:
        """All pairs below two nodes; below one node, if both are the same."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if not a.children and not b.children:
                self.compare(a.members, b.members, a is b)
                continue
            left, right = a.children or [a], b.children or [b]
            u, v = np.array([n.center for n in left]), np.array([n.center for n in right])
            r, s = np.array([n.radius for n in left]), np.array([n.radius for n in right])
            far = np.sqrt(np.maximum(0.0, 2 - 2 * (self.unit[u] @ self.unit[v].T)))
            near = far <= r[:, None] + s[None, :] + self.reach + _SLACK
            if a is b:
                near = np.triu(near)
            x, y = np.nonzero(near)
            single_a, single_b = np.array([len(n.members) == 1 for n in left]), np.array([len(n.members) == 1 for n in right])
            single = single_a[x] & single_b[y]
            self._count(u[x[single]], v[y[single]])
            todo += [(left[i], right[j]) for i, j in zip(x[~single], y[~single])]

    def _count(self, i: np.ndarray, j: np.ndarray) -> None:
        """Take the pairs whose cosine, in double precision, is not below the threshold."""
        i, j = i[i != j], j[i != j]
        for low in range(0, len(i), 1 << 16):
            x, y = i[low : low + (1 << 16)], j[low : low + (1 << 16)]
            cosine = (self.vectors[x] * self.vectors[y]).sum(axis=1) / (self.norms[x] * self.norms[y])
            x, y = x[cosine >= self.least], y[cosine >= self.least]
            np.add.at(self.counts, x, self.weights[y])
            np.add.at(self.counts, y, self.weights[x])
            if len(x):
                self.pairs.append((x, y))

    def labels(self) -> np.ndarray:
        """For each row the least row that its links reach."""
        out = np.arange(len(self.vectors))
        changed = True
        while changed:
            before = out.copy()
            for i, j in self.pairs:
                low = np.minimum(out[i], out[j])
                np.minimum.at(out, i, low)
                np.minimum.at(out, j, low)
            out = out[out]
            changed = not np.array_equal(out, before)
        return out


def usable(vector):
    """Whether a vector can link: not null, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _dealt(distinct: DataFrame, reach: float, block: int, most_centers: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the part they are in, and the pairs of parts that can hold links.

    A label of more than block rows is divided by nearest center, among as many centers as it has
    blocks of rows, up to most_centers; then by hash into parts of about block rows. Parts whose
    centers are farther apart than their radii and the threshold allow are never compared. Centers
    are a bounded sample of the rows, the same for all labels.
    """
    centers = distinct.orderBy(F.xxhash64("v"), "label").limit(most_centers).select("v").collect()
    by_dims: dict[int, list] = {}
    for row in centers:
        by_dims.setdefault(len(row["v"]), []).append(row["v"])
    points = {d: np.array(v, float) for d, v in by_dims.items()}
    points = {d: v / np.sqrt((v * v).sum(axis=1))[:, None] for d, v in points.items()}

    def nearest(batches):
        for batch in batches:
            cells, far = [], []
            for v, few in zip(batch.column(1), batch.column(5).to_pylist()):
                x = np.asarray(v.values, float)
                c = points.get(len(x), np.zeros((0, len(x))))[:few]
                if len(c) < 2:
                    cells.append(-1)
                    far.append(2.0)
                    continue
                cosine = c @ x / np.sqrt(x @ x)
                k = int(cosine.argmax())
                cells.append(k)
                far.append(float(np.sqrt(max(0.0, 2 - 2 * cosine[k]))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(cells, pa.int32()), pa.array(far, pa.float64())], names=[*batch.schema.names[:5], "cell", "far"])

    sizes = distinct.groupBy("label", "dims").agg(F.least(F.ceil(F.count("*") / F.lit(block)), F.lit(most_centers)).cast("int").alias("few"))
    placed = distinct.join(sizes, ["label", "dims"]).select("label", "v", "rep", "weight", "dims", "few")
    label_type = distinct.schema["label"].dataType.simpleString()
    placed = map_arrow(placed, nearest, f"label {label_type}, v array<double>, rep long, weight long, dims int, cell int, far double")
    placed = written(placed, "vectors-cells")
    cells = placed.groupBy("label", "dims", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    cells = cells.withColumn("chunks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    keys = ["label", "dims", "cell"]
    parted = placed.join(cells.select(*keys, "chunks"), keys)
    parted = parted.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).drop("chunks", "far")

    def one(side: str) -> DataFrame:
        return cells.select("label", "dims", *(F.col(c).alias(f"{side}_{c}") for c in ("cell", "radius", "chunks")))

    gaps = {d: np.sqrt(np.maximum(0.0, 2 - 2 * p @ p.T)) for d, p in points.items()}

    def possible(batches):
        for batch in batches:
            t = batch.to_pydict()
            keep = [
                a < 0 or b < 0 or d not in gaps or gaps[d][a, b] <= r + s + reach + _SLACK
                for d, a, b, r, s in zip(t["dims"], t["a_cell"], t["b_cell"], t["a_radius"], t["b_radius"])
            ]
            yield batch.filter(pa.array(keep, pa.bool_()))

    pairs = one("a").join(one("b"), ["label", "dims"]).where("a_cell <= b_cell")
    pairs = map_arrow(pairs, possible, pairs.schema)
    pairs = pairs.withColumn("a_chunk", F.explode(F.sequence(F.lit(0), F.col("a_chunks") - 1)))
    pairs = pairs.withColumn("b_chunk", F.explode(F.sequence(F.lit(0), F.col("b_chunks") - 1)))
    pairs = pairs.where("a_cell < b_cell or a_chunk <= b_chunk")
    return parted, pairs.select("label", "dims", "a_cell", "a_chunk", "b_cell", "b_chunk")



def near_vectors(
    vectors: DataFrame,
    least: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    block: int = 2048,
    most_centers: int = 256,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector; links join vectors of one label.

    Vectors link if their labels are equal and not null, they have the same number of components,
    and the cosine of their doubles is at least `least`; vectors that are null, zero or hold a null
    or non-finite component link with nothing and are components of their own. n_links counts the
    other rows linked directly, component_id is the least id reachable, kept says that it is the
    row's own. Rows link by their vectors, so repeated rows link with each other, and an id on several
    vectors has the links of each on its row; labels of any type are compared as they are. A null id is never anyone's component, links
    with nothing, and is kept. An empty table gives an empty result; further columns are ignored.

    Equal vectors of a label are one vector with a weight, so copies are never compared. The rest
    is dealt to parts of bounded size; pairs of parts that can hold links are compared, each by the
    cover trees of both. A pair of parts gives back counts and at most one link for each vector
    that joins what it has linked.
    """
    given = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    linkable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))
    rows = given.withColumn("dims", F.when(linkable, F.size("v")))
    distinct = rows.where("dims is not null").groupBy("label", "v", "dims").agg(F.min("vec_id").cast("long").alias("id"), F.count("*").alias("weight"))
    # An id may stand on several vectors, so a vector is named by a number of its own, given where it is written.
    distinct = distinct.select("label", "v", F.monotonically_increasing_id().alias("rep"), "weight", "dims", "id")
    distinct = written(distinct, "vectors-distinct")
    reach = float(np.sqrt(2 - 2 * least))
    parted, pairs = _dealt(distinct, reach, block, most_centers)
    pairs = pairs.withColumn("pair", F.struct("label", "dims", "a_cell", "a_chunk", "b_cell", "b_chunk"))
    keys = ["label", "dims"]

    def side(s: str) -> DataFrame:
        own = parted.withColumnsRenamed({"cell": f"{s}_cell", "chunk": f"{s}_chunk"})
        return own.join(pairs.select(*keys, f"{s}_cell", f"{s}_chunk", "pair"), [*keys, f"{s}_cell", f"{s}_chunk"]).select(
            *(F.col(c).alias(c) for c in ("pair", "rep", "weight", "v"))  # columns of its own for each side
        )

    def compare(key, left: pa.Table, right: pa.Table) -> pa.Table:
        pair = key[0].as_py()
        same = (pair["a_cell"], pair["a_chunk"]) == (pair["b_cell"], pair["b_chunk"])
        both = left if same else pa.concat_tables([left, right])
        reps = np.asarray(both.column("rep"))
        v = both.column("v").combine_chunks()
        flat = np.asarray((pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v).flatten(), float)
        links = Links(flat.reshape(len(reps), -1), np.asarray(both.column("weight")), least)
        n = left.num_rows
        a = build(links.unit, np.arange(n)) if n else None
        b = a if same else build(links.unit, np.arange(n, len(reps))) if len(reps) > n else None
        if a and b:
            links.traverse(a, b)
        labels = links.labels()
        on = np.flatnonzero((links.counts > 0) | (labels != np.arange(len(reps))))
        return pa.Table.from_arrays([pa.array(reps[on]), pa.array(links.counts[on]), pa.array(reps[labels[on]])], names=["rep", "links", "joined"])

    found = side("a").groupBy("pair").cogroup(side("b").groupBy("pair")).applyInArrow(compare, "rep long, links long, joined long")
    found = written(found, "vectors-links")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found, "rep", "joined", "vectors-components").withColumnRenamed("id", "rep")
    classes = distinct.select("label", "v", "rep", "weight", "id").join(linked, "rep", "left").join(joined, "rep", "left")
    lowest = classes.where("component is not null").groupBy("component").agg(F.min("id").alias("low"))
    classes = classes.join(lowest, "component", "left")
    classes = classes.select("label", "v", F.col("weight").alias("w"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("low", "id").alias("component"))
    own = rows.withColumn("mine", F.when(F.col("dims").isNotNull(), F.col("v")))
    out = own.join(classes, (own["label"] == classes["label"]) & (own["mine"] == classes["v"]), "left")
    return out.select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("w") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


ORACLE = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (
    SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (a.norm * b.norm) >= 0.93
), reach AS (
    SELECT a, b FROM links
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
    SELECT a, min(b) AS low FROM reach GROUP BY a
), counted AS (
    SELECT a, count(*) AS links FROM links GROUP BY a
)
SELECT vec_id, coalesce(links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
    least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.a LEFT JOIN counted ON vec_id = counted.a
"""
