"""MinHash near-duplicates by a signature-coordinate inverted join.

Every distinct shingle set has a signature of k minima. It is posted under each pair of coordinate
and value. Sets that are similar enough agree in at least t of k coordinates but for a chance of
less than one in a million. So two of them agree in both coordinates of at least k / 2 - (k - t) of the k / 2
pairs of neighbouring coordinates, which unlike sets hardly ever do: a first join by such pairs leaves out the
sets that share too few of them with any other. Of the postings of the rest, those that no other set shares are
skipped; a set with more than k - t of them has no partner; and of the others only the rarest k - t + m postings (the prefix) need
to be merged, because two sets that agree in t coordinates meet in m of these. Pairs that meet so
often have their collisions counted on the signatures, and what passes is confirmed on the full sets.

Links serve to join documents to classes, so not every pair has to be listed. First, every set
points to the center it meets most often: a posting's center is the member that shares its
coordinates with the most others, as the original of many copies does. Sets whose pointers lead to
the same center form a home; the sets of a home are compared block by block, and only links that
join classes leave a block. Last come the pairs whose homes and classes differ.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trendloom.llm.common import SPACE, discard, few, map_arrow, mixed, ship, slices, utf8, words, written
from trendloom.llm.graph import components


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, least similarity in hundredths, the signature, sets in a block, meetings in a prefix.

    coordinates and matches: at similarity 0.8 the number of equal ones of 64 is binomial with
    mean 51.2 and deviation 3.2; fewer than 35 happen once in three million pairs at the very
    threshold, and far less often above it.
    """

    words: int = 2
    percent: int = 80
    coordinates: int = 64
    matches: int = 35
    seed: int = 5
    block: int = 1024
    meetings: int = 5


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-word shingles of consecutive texts, sorted within a text, and where each text's begin."""
    index, _, (h,) = words(data, at, SPACE)
    count = np.diff(index)
    texts = len(count)
    owner = np.repeat(np.arange(texts), count)
    made = mixed(h, 1)
    shingle = made.copy()
    for j in range(1, n):
        shingle[: len(h) - j] = mixed(shingle[: len(h) - j] * np.uint64(3) + made[j:], j)
    # position in its text; a shingle needs n words, a shorter text is one shingle
    behind = index[1:][owner] - np.arange(len(h))
    keep = behind >= n
    short = np.flatnonzero((count > 0) & (count < n))
    hashes, owners = shingle[keep], owner[keep]
    if len(short):
        extra = []
        for t in short:
            value = made[index[t] : index[t] + 1]
            for j in range(1, count[t]):
                value = mixed(value * np.uint64(3) + made[index[t] + j : index[t] + j + 1], j)
            extra.append(mixed(value, 100 + int(count[t]))[0])
        hashes, owners = np.concatenate([hashes, np.array(extra, np.uint64)]), np.concatenate([owners, short])
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    if len(hashes):
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])])
        hashes, owners = hashes[new], owners[new]
    return hashes, np.searchsorted(owners, np.arange(texts + 1))


def signatures(hashes: np.ndarray, starts: np.ndarray, rule: Rule) -> np.ndarray:
    """One row of minima for each text that has a shingle."""
    filled = np.flatnonzero(np.diff(starts))
    out = np.empty((len(filled), rule.coordinates), np.uint64)
    if len(filled):
        rng = np.random.default_rng(rule.seed)
        odd = rng.integers(0, 2**63, rule.coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for c in range(rule.coordinates):
            value = hashes * odd[c]
            value ^= value >> np.uint64(29)
            value *= np.uint64(0xBF58476D1CE4E5B9)
            value ^= value >> np.uint64(32)
            out[:, c] = np.minimum.reduceat(value, starts[:-1][filled])
    return out


def _digests(hashes: np.ndarray, starts: np.ndarray) -> list[pa.Array]:
    """A 128-bit digest of each set, in two columns."""
    filled = np.flatnonzero(np.diff(starts))
    out = []
    for k in (7, 8):
        total = np.zeros(len(starts) - 1, np.uint64)
        if len(filled):
            total[filled] = np.add.reduceat(mixed(hashes, k), starts[:-1][filled])
        out.append(pa.array(total.view(np.int64)))
    return out


_COORDINATE_BYTES = 6


def _rows(column: pa.Array) -> np.ndarray:
    """The minima of packed signatures, one row each."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1, _COORDINATE_BYTES)
    wide = np.zeros((*raw.shape[:2], 8), np.uint8)
    wide[:, :, :_COORDINATE_BYTES] = raw
    return wide.view("<u8")[:, :, 0]


def _packed(rows: np.ndarray) -> list[bytes]:
    short = rows.astype("<u8").view(np.uint8).reshape(*rows.shape, 8)[:, :, :_COORDINATE_BYTES]
    return [r.tobytes() for r in np.ascontiguousarray(short)]


def _signed(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n, set_a, set_b (a digest of the set) and the packed signature of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for low, high in slices(at):
                hashes, starts = shingle_sets(data, at[low : high + 1], rule.words)
                n = np.diff(starts)
                sigs: list[bytes | None] = [None] * len(n)
                for t, sig in zip(np.flatnonzero(n), _packed(signatures(hashes, starts, rule))):
                    sigs[t] = sig
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high].cast(pa.int64()), pa.array(n, pa.int64()), *_digests(hashes, starts), pa.array(sigs, pa.binary())],
                    names=["doc_id", "n", "set_a", "set_b", "sig"],
                )

    return map_arrow(docs, run, "doc_id long, n long, set_a long, set_b long, sig binary")


def _posted(sets: DataFrame, together: int = 1) -> DataFrame:
    """key and rep: each set under each of its coordinate-value pairs, or under so many neighbouring ones together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _rows(batch.column(1))
                places = range(0, rows.shape[1] - together + 1, together)
                keys = np.stack([mixed(rows[:, c], 1000 + c) for c in places], axis=1)
                for j in range(1, together):
                    keys = mixed(keys * np.uint64(3) + rows[:, j::together][:, : keys.shape[1]], j)
                reps = np.repeat(np.asarray(batch.column(0)), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(reps)], names=["key", "rep"])

    return map_arrow(sets.select("rep", "sig"), run, "key long, rep long")


def _partnered(sets: DataFrame, rule: Rule) -> DataFrame:
    """The sets that share as many pairs of neighbouring coordinates with others as similar sets do.

    Each of the k - t coordinates in which similar sets may differ spoils one pair at most. The values of one coordinate
    are met by ever more unlike sets as these grow in number, those of two at once are not.
    """
    least = rule.coordinates // 2 - (rule.coordinates - rule.matches)
    if least < 1:
        return sets
    posted = _posted(sets, 2)
    shared = posted.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1").select("key")
    often = posted.join(shared, "key").groupBy("rep").agg(F.count("*").alias("keys")).where(F.col("keys") >= least)
    return sets.join(few(written(often.select("rep"), "minhash-partnered")), "rep", "left_semi")


def _prefixes(sets: DataFrame, rule: Rule) -> DataFrame:
    """key, rep and weight of the postings that have to be merged; weight: how much a set shares with others."""
    posted = _posted(sets)
    shared = posted.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1")
    own = F.sort_array(F.collect_list(F.struct("sets", "key")))  # at most `coordinates` of them
    mine = posted.join(shared, "key").groupBy("rep").agg(own.alias("own"), F.sum("sets").alias("weight"))
    prefix = F.slice("own", F.lit(1), F.size("own") - (rule.matches - rule.meetings))
    mine = mine.where(F.size("own") >= rule.matches).select("rep", "weight", F.explode(prefix).alias("p"))
    return mine.select(F.col("p.key").alias("key"), "rep", "weight")


def _counted(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """a, b, matches: pairs whose sizes allow the similarity and whose signatures collide often enough."""
    sized = sets.select("rep", "n", "sig")
    both = pairs.join(sized.toDF("a", "na", "sa"), "a").join(sized.toDF("b", "nb", "sb"), "b")
    both = both.where(100 * F.least("na", "nb") >= rule.percent * F.greatest("na", "nb"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                matches = (_rows(batch.column(2)) == _rows(batch.column(3))).sum(axis=1)
                made = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(matches, pa.int32())], names=["a", "b", "matches"])
                yield made.filter(pa.array(matches >= rule.matches))

    return map_arrow(both.select("a", "b", "sa", "sb"), run, "a long, b long, matches int")


def _members(sets: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """rep and the packed full set of the given sets, made from the texts of their first documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for low, high in slices(at):
                hashes, starts = shingle_sets(data, at[low : high + 1], rule.words)
                packed = [hashes[a:b].astype("<u8").tobytes() for a, b in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_arrays([*_digests(hashes, starts), pa.array(packed, pa.binary())], names=["set_a", "set_b", "members"])

    first = few(sets.select(F.col("first").alias("doc_id")).distinct())
    made = map_arrow(docs.join(first, "doc_id", "left_semi").select("doc_id", "text"), run, "set_a long, set_b long, members binary")
    made = made.select(_rep().alias("rep"), "members")
    return made.join(few(sets.select("rep")), "rep", "left_semi")  # repeated rows of a document may come twice


def _rep():
    """The number of a distinct set."""
    return F.xxhash64("set_a", "set_b")


def _similar(pairs: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """a, b: the pairs whose full sets are similar enough."""
    both = pairs.join(members.toDF("a", "ma"), "a").join(members.toDF("b", "mb"), "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= rule.percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both.select("a", "b", "ma", "mb"), run, "a long, b long")


def _intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, as products of 0/1 matrices."""
    flat = [np.concatenate(side) if side else np.zeros(0, np.uint64) for side in (x, y)]
    both = np.intersect1d(*flat)  # a shingle of one side only adds nothing
    rows = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (x, y)]
    place = [np.searchsorted(both, f) for f in flat]
    known = [(p < len(both)) & (both[np.minimum(p, len(both) - 1)] == f) if len(both) else np.zeros(len(f), bool) for p, f in zip(place, flat)]
    total = np.zeros((len(x), len(y)), np.float32)
    for low in range(0, len(both), 4096):
        part = []
        for side, r, p, k in zip((x, y), rows, place, known):
            inside = k & (p >= low) & (p < low + 4096)
            matrix = np.zeros((len(side), min(4096, len(both) - low)), np.float32)
            matrix[r[inside], p[inside] - low] = 1
            part.append(matrix)
        total += part[0] @ part[1].T
    return total


def _joined_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that the links (i, j) reach."""
    out = np.arange(n)
    while True:
        before = out.copy()
        low = np.minimum(out[i], out[j])
        np.minimum.at(out, i, low)
        np.minimum.at(out, j, low)
        out = out[out]
        if np.array_equal(out, before):
            return out


def _inside_homes(homes: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """a, b: links that join the sets of each home; homes: rep, home.

    A home is cut into blocks of bounded size; each pair of blocks compares all its sets.
    """
    sizes = homes.groupBy("home").agg(F.count("*").alias("sets")).where("sets > 1")
    sizes = sizes.select("home", F.ceil(F.col("sets") / F.lit(rule.block)).cast("int").alias("blocks"))
    own = homes.join(sizes, "home").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    own = own.join(members, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.struct("home", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pair = key[0].as_py()
        block = np.asarray(table.column("block"))
        reps = np.asarray(table.column("rep"))
        sets = [np.frombuffer(v.as_buffer(), "<u8") for v in table.column("members")]
        left, right = (np.flatnonzero(block == pair[side]) for side in ("low", "high"))
        common = _intersections([sets[k] for k in left], [sets[k] for k in right]).astype(np.int64)
        n = np.array([len(x) for x in sets], np.int64)
        i, j = np.nonzero(100 * common >= rule.percent * (n[left][:, None] + n[right][None, :] - common))
        labels = _joined_labels(len(reps), left[i], right[j])
        moved = np.flatnonzero(labels != np.arange(len(reps)))
        return pa.Table.from_arrays([pa.array(reps[moved]), pa.array(reps[labels[moved]])], names=["a", "b"])

    ship(homes.sparkSession)
    return own.select(pair.alias("pair"), "block", "rep", "members").groupBy("pair").applyInArrow(compare, "a long, b long")


def _met_often(pairs: DataFrame, rule: Rule) -> DataFrame:
    """a, b, met: the pairs that meet in enough postings of their prefixes."""
    return pairs.groupBy("a", "b").agg(F.count("*").alias("met")).where(F.col("met") >= rule.meetings)


def _band(n: Column, rule: Rule) -> Column:
    """The size band of a set: similar sets lie in one band or in neighbours, which are a little wider than needed."""
    width = max(-math.log(rule.percent / 100), 0.01) * (1 + 1e-6)
    return F.floor(F.log(n.cast("double")) / F.lit(width)).cast("int")


def _between_classes(own: DataFrame, rule: Rule) -> DataFrame:
    """key, cell, rep, home, class, n: the postings where sets of several homes and classes meet.

    A posting is cut into cells by size: a set lies in the cell of its band and in the next, so two
    sets whose sizes allow the similarity meet in the cell of the larger one's band.
    """
    band = _band(F.col("n"), rule)
    own = own.select("key", F.explode(F.array(band, band + 1)).alias("cell"), "rep", "home", "class", "n")
    lists = own.groupBy("key", "cell").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min("home").alias("near"), F.max("home").alias("far"))
    return own.join(lists.where("low != high and near != far").select("key", "cell"), ["key", "cell"], "left_semi")


def _meeting_often(own: DataFrame, rule: Rule) -> DataFrame:
    """The postings of the sets that lie in enough of them to meet another as often as a link needs."""
    often = own.groupBy("rep").agg(F.count_distinct("key").alias("keys")).where(F.col("keys") >= rule.meetings)
    return own.join(few(often.select("rep")), "rep", "left_semi")


def _roots(pointers: DataFrame, jumps: int = 3) -> DataFrame:
    """rep and root: where the pointers b -> a lead, followed at most 2 ** jumps steps.

    Pointers lead to sets of greater weight, so they form trees.
    """
    ends = pointers.select(F.col("a").alias("rep")).unionByName(pointers.select(F.col("b").alias("rep"))).distinct()
    up = few(pointers.select(F.col("b").alias("rep"), "a"))
    found = ends.join(up, "rep", "left").select("rep", F.coalesce("a", "rep").alias("root"))
    for _ in range(jumps):
        further = few(found.select(F.col("rep").alias("root"), F.col("root").alias("next")))
        found = written(found.join(further, "root").select("rep", F.col("next").alias("root")), "minhash-roots")
    return found


def _links(sets: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """rep and component of the sets that are linked to others."""
    prefixes = written(_prefixes(_partnered(sets, rule), rule), "minhash-prefixes")
    made = [prefixes]

    def kept(rows: DataFrame, purpose: str = "links") -> DataFrame:
        found = written(rows, f"minhash-{purpose}")
        made.append(found)
        return found

    def members_of(ends: DataFrame) -> DataFrame:
        reps = ends.select(F.col("a").alias("rep")).unionByName(ends.select(F.col("b").alias("rep"))).distinct()
        return kept(_members(sets.join(few(reps), "rep", "left_semi"), docs, rule), "members")

    def joined_by(edges: DataFrame) -> DataFrame:
        return written(components(edges, purpose="minhash-classes"), "minhash-joined").withColumnRenamed("id", "rep")

    # Every set points to the center it meets most often; centers share more than those that point to them.
    center = prefixes.groupBy("key").agg(F.max_by("rep", F.struct("weight", "rep")).alias("a"))
    pairs = prefixes.join(center, "key").where("rep != a").select("a", F.col("rep").alias("b"))
    best = _met_often(pairs, rule).groupBy("b").agg(F.max_by("a", F.struct("met", "a")).alias("a"))
    best = kept(_counted(best.select("a", "b"), sets, rule).select("a", "b"))
    homes = _roots(best).withColumnRenamed("root", "home")
    links = kept(_inside_homes(homes, members_of(best), rule))
    joined = joined_by(links)

    # Pairs of different homes and classes that meet often, and whose sizes allow the similarity.
    own = prefixes.select("key", "rep").join(homes, "rep", "left").join(joined, "rep", "left")
    own = own.select("key", "rep", F.coalesce("home", "rep").alias("home"), F.coalesce("component", "rep").alias("class"))
    open_postings = kept(_between_classes(own.join(sets.select("rep", "n"), "rep"), rule), "open")  # read twice
    own = kept(_meeting_often(open_postings, rule), "between")
    pairs = own.toDF("key", "cell", "b", "home_b", "class_b", "n_b").join(own.toDF("key", "cell", "a", "home_a", "class_a", "n_a"), ["key", "cell"])
    pairs = pairs.where("a < b and home_a != home_b and class_a != class_b").where(
        (F.col("cell") == F.greatest(_band(F.col("n_a"), rule), _band(F.col("n_b"), rule)))
        & (100 * F.least("n_a", "n_b") >= rule.percent * F.greatest("n_a", "n_b"))
    ).select("a", "b")
    pairs = kept(_counted(_met_often(pairs, rule).select("a", "b"), sets, rule).select("a", "b"))
    if not pairs.isEmpty():
        more = kept(_similar(pairs, members_of(pairs), rule))
        if not more.isEmpty():
            made.append(joined)
            joined = joined_by(links.unionByName(more))
    discard(*made)
    return joined


def _decided(texts: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n, rep, least and best of every row.

    rep: the number of its set, null without words; least: the smallest id of its component;
    best: the one set of the component that stands for it, of a document with that id.
    """
    signed = written(_signed(texts, rule), "minhash-signatures").withColumn("rep", _rep())
    usable = signed.where("n > 0 and doc_id is not null")
    sets = usable.groupBy("rep").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    sets = written(sets, "minhash-sets")
    joined = _links(sets, texts, rule)
    linked = joined.join(sets.select("rep", "first"), "rep")
    least = linked.groupBy("component").agg(F.min(F.struct("first", "rep")).alias("l"))
    least = least.select("component", F.col("l.first").alias("least"), F.col("l.rep").alias("best"))
    classes = sets.select("rep", "first").join(linked.join(least, "component").select("rep", "least", "best"), "rep", "left")
    classes = classes.select("rep", F.coalesce("least", "first").alias("least"), F.coalesce("best", "rep").alias("best"))
    own = signed.select("doc_id", "n", F.when(F.col("n") > 0, F.col("rep")).alias("rep"))
    return own.join(classes, "rep", "left")


def near_documents(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Words are runs of anything but space and \\t to \\r, with A-Z in lower case. Documents are
    linked if the intersection of their sets of distinct shingles holds at least rule.percent
    hundredths of the union; a text of fewer words is one shingle. component_id is the smallest
    doc_id reachable by links, itself included; kept says that it is the document's own. A text
    without words, null or empty, has an empty set and links with nothing. Repeated rows are
    copies of each other, of which all with the smallest id are kept; a null id has a null
    component, is kept, and joins no other. An empty table gives an empty result; further columns
    are ignored. Equal sets are one node, however many documents have them.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return _decided(texts, rule).select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def first_of_each(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", repeats: bool = True) -> DataFrame:
    """The rows of docs that near_documents keeps, with all their columns.

    A row is told from others of its id by its set. Without repeats one row of each component is
    left: of rows with the smallest id those of one set, of these the one with the least text; a
    null id is larger than all others and is compared too. Texts without words all stay.
    """
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    if not repeats:
        doc_id = F.coalesce(doc_id, _behind(docs.select(doc_id.alias("doc_id"))) + F.pmod(F.xxhash64(text), F.lit(1 << 31)))
    decided = _decided(docs.select(doc_id.alias("doc_id"), text.alias("text")), rule)
    first = F.col("least") == F.col("doc_id")
    stays = F.coalesce(first if repeats else first & (F.col("best") == F.col("rep")), F.lit(True))
    decided = decided.select("doc_id", "rep", stays.alias("stays"))
    sets = decided.groupBy("doc_id", "rep", "stays").agg(F.count("*").alias("rows"))
    left = F.when(F.col("stays"), F.col("rows") if repeats else F.when(F.col("rep").isNull(), F.col("rows")).otherwise(1)).otherwise(0)
    ids = sets.groupBy("doc_id").agg(F.sum("rows").alias("rows"), F.sum(left).alias("left")).where("left < rows")
    ids = written(ids.select("doc_id", "left"), "minhash-dropped")
    name = max(docs.columns, key=len) + "_"  # no column of docs
    met = lambda some: few(some.select(F.col("doc_id").alias(name)))
    rest = docs.join(met(ids), doc_id == F.col(f"`{name}`"), "left_anti")
    mixed = ids.where("left > 0")  # ids of which some rows stay and some go
    if mixed.isEmpty():
        return rest
    good = decided.where("stays").join(few(mixed.select("doc_id")), "doc_id", "left_semi").select("doc_id", "rep").distinct()
    good = few(written(good, "minhash-kept").select(F.col("doc_id").alias("id"), F.col("rep").alias("set")))
    rows = docs.join(met(mixed), doc_id == F.col(f"`{name}`"), "left_semi")
    rows = _with_sets(rows.select(doc_id.alias("doc_id"), text.alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), rule)
    rows = rows.join(good, (F.col("doc_id") == F.col("id")) & F.col("rep").eqNullSafe(F.col("set")), "left_semi")
    if not repeats:
        one = F.min_by("row", F.struct("text", F.to_json("row"))).alias("row")
        rows = rows.where("rep is null").select("row").unionByName(rows.where("rep is not null").groupBy("doc_id", "rep").agg(one).select("row"))
    return rest.unionByName(map_arrow(rows.select("row.*"), _same, docs.schema))  # what is never null stays so


def _same(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches


def _behind(ids: DataFrame):
    """An id behind all others, with room for 31 bits. Rows that get one id are still told apart by their sets."""
    most = ids.agg(F.max("doc_id")).first()[0]
    return F.lit(min(max(most or 0, 0) + 1, 2**63 - 2**31)).cast("long")


def _with_sets(rows: DataFrame, rule: Rule) -> DataFrame:
    """The rows, of a doc_id, a text and a struct, with the number of the text's set, null without words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for low, high in slices(at):
                hashes, starts = shingle_sets(data, at[low : high + 1], rule.words)
                some = batch.slice(low, high - low)
                columns = [*some.columns, pa.array(np.diff(starts), pa.int64()), *_digests(hashes, starts)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "n", "set_a", "set_b"])

    schema = StructType(list(rows.schema.fields)).add("n", "long").add("set_a", "long").add("set_b", "long")
    return map_arrow(rows, run, schema).withColumn("rep", F.when(F.col("n") > 0, _rep()))


ORACLE = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS words
    FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(words) = 1 THEN words
        ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS s
    FROM w
), posted AS (
    SELECT doc_id, unnest(s) AS t FROM sets
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM posted a JOIN posted b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
    WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)
), reach AS (
    SELECT a, b FROM links
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
    SELECT a, min(b) AS low FROM reach GROUP BY a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
    least(doc_id, coalesce(low, doc_id)) = doc_id AS kept
FROM sets LEFT JOIN least ON doc_id = a
"""
