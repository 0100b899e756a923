"""Repeated strings of the corpus, found by deep-shallow suffix sorting.

Of every string of `length` bytes the least of its short substrings (by hash) is its anchor.
Strings that follow each other and share an anchor travel as one run: the suffixes that begin at
anchors, with the bytes before them. Equal strings have equal anchors, so that runs whose anchor's
hash occurs once in the corpus are put aside, and the rest are sorted hash by hash: multikey
quicksort orders the suffixes to a shallow depth; groups that are equal that far are ordered by a
blind trie, which looks at branching bytes and compares each suffix with one other. From the order
and the common prefixes of neighbours follows which strings occur earlier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import discard, few, map_arrow, mixed, powers, slices, utf8, written

#: Bytes of a text that are hashed at a time.
PART = 1 << 20


@dataclass(frozen=True)
class Rule:
    """Bytes of a repeated string; bytes of an anchor; depth from which on tries sort.

    hot_runs: runs of one anchor hash beyond which its strings are compared by digests, spread
    over all tasks, and not sorted in one.
    """

    length: int = 100
    anchor: int = 32
    shallow: int = 48
    hot_runs: int = 200_000


# --- runs -----------------------------------------------------------------------------------


def runs(data: np.ndarray, at: np.ndarray, rule: Rule) -> tuple[np.ndarray, ...]:
    """Runs of strings with a common anchor in consecutive texts.

    Returns, for each run: its text's number, the place of its first string in the text, the number
    of strings, the anchor's place behind the first string, and the anchor's hash.
    """
    out: list[tuple[np.ndarray, ...]] = []
    size = at[-1] - at[0]
    low = 0
    while low < size:  # parts overlap by all but one byte of a string, so each string is in one
        out.append(_part_runs(data[at[0] + low : at[0] + min(size, low + PART + rule.length - 1)], at - at[0] - low, rule))
        low += PART
    text, begin, count, offset, hashes = (np.concatenate(c) for c in zip(*out)) if out else [np.zeros(0, np.int64)] * 5
    return text, begin, count, offset, hashes


def _part_runs(block: np.ndarray, edges: np.ndarray, rule: Rule) -> tuple[np.ndarray, ...]:
    """The runs of one part; edges: where texts begin and end, relative to the part."""
    n, k = len(block), rule.anchor
    strings = min(n - rule.length + 1, PART)
    if strings <= 0:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    up, down = powers(PART + rule.length + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    hashes = mixed((total[k:] - total[:-k]) * down[: n - k + 1])
    bits = np.uint64(21)
    least = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    width, want = 1, rule.length - k + 1
    while 2 * width <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    anchor = (least[:strings] & np.uint64((1 << 21) - 1)).astype(np.int64)
    place = np.arange(strings)
    text = np.searchsorted(edges, place, "right") - 1
    whole = place + rule.length <= edges[np.minimum(text + 1, len(edges) - 1)]
    change = np.ones(strings, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, strings))
    keep = whole[first]
    first, count = first[keep], count[keep]
    return text[first], first - edges[text[first]], count, anchor[first] - first, hashes[anchor[first]]


# --- deep-shallow sorting -------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes) -> int:
    """Bytes that two strings share at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - 1 - (x.bit_length() - 1) // 8


_WORD = 8


def multikey(items: list[int], texts: list[bytes], depth: int, rule: Rule, out: list[int]) -> None:
    """Append items in the order of their texts, which agree in the first depth bytes.

    Three-way quicksort on the next bytes, some at a time, as long as the depth is shallow.
    """
    todo = [(items, depth)]
    while todo:
        items, depth = todo.pop()
        if len(items) == 1:
            out.append(items[0])
            continue
        if depth >= rule.shallow:
            out += blind_trie(items, texts)
            continue
        keys = {i: texts[i][depth : depth + _WORD] for i in items}
        pivot = keys[items[len(items) // 2]]
        less, same, more = [], [], []
        for i in items:
            key = keys[i]
            (same if key == pivot else less if key < pivot else more).append(i)
        if more:
            todo.append((more, depth))
        if len(pivot) < _WORD:  # their texts end here, equal
            todo += [([i], depth) for i in reversed(same)]
        else:
            todo.append((same, depth + _WORD))
        if less:
            todo.append((less, depth))


def blind_trie(items: list[int], texts: list[bytes]) -> list[int]:
    """The items in the order of their texts.

    A node is [depth, children by the byte at that depth]; -1 stands for the end of a text. To
    insert, go down by branching bytes alone to some leaf, compare with it once, and branch where
    the two differ.
    """
    root: list | int = [0, {}]
    first = texts[items[0]]
    root = [len(first), {-1: [items[0]]}]
    for item in items[1:]:
        text = texts[item]
        node, path = root, []
        while True:
            path.append(node)
            depth, children = node
            byte = text[depth] if depth < len(text) else -1
            following = children.get(byte)
            if byte == -1 and -1 in children or following is None:
                break
            node = following
        leaf = node
        while -1 not in leaf[1]:
            leaf = next(iter(leaf[1].values()))
        shared = common_prefix(text, texts[leaf[1][-1][0]])
        place = next(n for n in path if n[0] >= shared) if path[-1][0] >= shared else path[-1]
        if place[0] == shared:
            byte = text[shared] if shared < len(text) else -1
            if byte == -1:
                place[1].setdefault(-1, []).append(item)
            else:
                place[1][byte] = [len(text), {-1: [item]}]
        else:  # a new branch above place, which keeps its identity for its parent
            other = texts[leaf[1][-1][0]]
            below = [place[0], place[1]]
            place[0], place[1] = shared, {other[shared]: below}
            if shared < len(text):
                place[1][text[shared]] = [len(text), {-1: [item]}]
            else:
                place[1][-1] = [item]
    out: list[int] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, int):
            out.append(node)
            continue
        for byte in sorted(node[1], reverse=True):
            todo += reversed(node[1][byte]) if byte == -1 else [node[1][byte]]
    return out


Run = tuple[tuple[int, int], int, bytes, int, int]  # document, place, bytes, anchor's offset, strings


def repeated(found: list[Run], rule: Rule) -> Iterator[tuple[tuple[int, int], int, int]]:
    """(document, start, end) of bytes in strings that occur earlier, among the runs of one anchor.

    A run whose bytes occur as an earlier run is repeated as a whole. For the first run of each
    content the suffixes at the anchors are sorted; strings with o bytes before the anchor are
    equal if neighbours in that order share length - o bytes and the o bytes before agree.
    """
    first: dict[tuple[bytes, int], int] = {}
    found.sort(key=lambda r: (r[0], r[1]))
    for i, (doc, place, text, offset, _) in enumerate(found):
        j = first.setdefault((text, offset), i)
        if j != i and found[j][:2] != (doc, place):  # not a repeated row of the same document
            yield doc, place, place + len(text)
    if len(first) == 1:
        return
    chosen = list(first.values())
    texts = [found[i][2][found[i][3] :] for i in chosen]
    order: list[int] = []
    multikey(list(range(len(chosen))), texts, 0, rule, order)
    share = [0, *(common_prefix(texts[a], texts[b]) for a, b in zip(order, order[1:]))]
    before = [found[i][2][: found[i][3]] for i in chosen]
    covered: dict[int, list[int]] = {}
    offsets = [(found[i][3] - found[i][4] + 1, found[i][3]) for i in chosen]
    for o in range(min(a for a, _ in offsets), max(b for _, b in offsets) + 1):
        earliest: dict[bytes, list[int]] = {}
        for position, i in enumerate(order):
            if share[position] < rule.length - o:
                _later(earliest, found, chosen, o, covered)
                earliest = {}
            if offsets[i][0] <= o <= offsets[i][1]:
                left = before[i]
                earliest.setdefault(left[len(left) - o :], []).append(i)
        _later(earliest, found, chosen, o, covered)
    for i, starts in covered.items():
        doc = found[chosen[i]][0]
        starts.sort()
        begin = previous = starts[0]
        for s in starts[1:]:
            if s > previous + 1:
                yield doc, begin, previous + rule.length
                begin = s
            previous = s
        yield doc, begin, previous + rule.length


def _later(groups: dict[bytes, list[int]], found: list[Run], chosen: list[int], o: int, covered: dict[int, list[int]]) -> None:
    """Note the string with o bytes before its anchor in every run but the earliest of each group."""
    for same in groups.values():
        if len(same) > 1:
            places = [(found[chosen[i]][0], found[chosen[i]][1] + found[chosen[i]][3] - o) for i in same]
            least = min(places)
            for i, place in zip(same, places):
                if place != least:
                    covered.setdefault(i, []).append(place[1])


# --- the job --------------------------------------------------------------------------------

_NO_ID = (1 << 63) - 1
_ID_SCHEMA = "key long, tie long"


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key (the id; null last), tie (tells texts of one id apart) and text of every row."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)).alias("key"),
        F.xxhash64(text).alias("tie"),
        text.alias("text"),
    )


def _posted(texts: DataFrame, rule: Rule) -> DataFrame:
    """hash, key, tie and place of every run."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(2))
            keys, ties = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for low, high in slices(at):
                text, begin, count, offset, hashes = runs(data, at[low : high + 1], rule)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(keys[low:high][text]), pa.array(ties[low:high][text]), pa.array(begin << 14 | count << 7 | offset)],
                    names=["hash", "key", "tie", "place"],
                )

    return map_arrow(texts.where(F.octet_length("text") >= rule.length), run, f"hash long, {_ID_SCHEMA}, place long")


def _carried(texts: DataFrame, met: DataFrame, rule: Rule) -> DataFrame:
    """The runs that share their anchor's hash with others, with their bytes."""
    lists = met.groupBy("key", "tie").agg(F.collect_set(F.struct("hash", "place", "hot")).alias("runs"))  # bounded by the text
    both = texts.join(lists, ["key", "tie"]).select("key", "tie", "text", "runs")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(2))
            lists = batch.column(3)
            for low in range(0, batch.num_rows, 64):
                rows = range(low, min(low + 64, batch.num_rows))
                part = lists.slice(low, 64)
                sizes = np.asarray([len(x) for x in part])
                found = part.flatten()
                place = np.asarray(found.field("place"))
                owner = np.repeat(np.arange(low, rows.stop), sizes)
                begin, count = place >> 14, place >> 7 & 127
                start = at[owner] + begin
                raw = [data[a : a + c].tobytes() for a, c in zip(start.tolist(), (count + rule.length - 1).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [found.field("hash"), batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), found.field("place"), found.field("hot"), pa.array(raw, pa.binary())],
                    names=["hash", "key", "tie", "place", "hot", "raw"],
                )

    return map_arrow(both, run, f"hash long, {_ID_SCHEMA}, place long, hot boolean, raw binary")


def _sorted_spans(carried: DataFrame, rule: Rule) -> DataFrame:
    """Repeated spans among runs, one anchor hash after the other."""
    ordered = carried.where("not hot").drop("hot").repartition("hash").sortWithinPartitions("hash")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(group: list[Run]) -> list[tuple]:
            return [(*doc, a, b) for doc, a, b in repeated(group, rule)] if len(group) > 1 else []

        current, group = None, []
        for batch in batches:
            out: list[tuple] = []
            for h, key, tie, place, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if h != current:
                    out += spans(group)
                    current, group = h, []
                group.append(((key, tie), place >> 14, raw, place & 127, place >> 7 & 127))
            yield _span_batch(out)
        yield _span_batch(spans(group))

    return map_arrow(ordered, run, f"{_ID_SCHEMA}, start long, end long")


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "tie", "start", "end"])


def _hot_spans(carried: DataFrame, rule: Rule) -> DataFrame:
    """Repeated spans of runs whose anchor is too frequent for one task, string by string."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, tie, place, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "tie", "place", "raw"))):
                for i in range(place >> 7 & 127):
                    out.append((hashlib.blake2b(raw[i : i + rule.length], digest_size=16).digest(), key, tie, (place >> 14) + i))
            columns = list(zip(*out)) or [(), (), (), ()]
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["string", "key", "tie", "start"])

    strings = map_arrow(carried.where("hot"), run, f"string binary, {_ID_SCHEMA}, start long")
    least = strings.groupBy("string").agg(F.min(F.struct("key", "tie", "start")).alias("least"))
    later = strings.join(least, "string").where(F.struct("key", "tie", "start") != F.col("least"))
    return later.select("key", "tie", "start", (F.col("start") + rule.length).alias("end"))


def spans(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, tie and spans of every document with repeated bytes: sorted, disjoint, in bytes.

    A byte is repeated if a string of rule.length bytes that covers it begins earlier too: in a
    document with a smaller id (null last; equal ids by 64 bits of a hash of their texts), or in the same
    document at an earlier place. Strings are those of the input. Rows with the same id and text
    are one document.
    """
    if not rule.anchor <= rule.length < rule.anchor + 127:
        raise ValueError("a string is longer than its anchor by less than 127 bytes")
    texts = _documents(docs, id_col, text_col)
    long = texts.where(F.octet_length("text") >= rule.length)
    ids = long.select(F.md5(F.col("text").cast("binary")).alias("digest"), "key", "tie", F.octet_length("text").cast("long").alias("n"))
    ids = written(ids, "repeats-ids")
    classes = ids.groupBy("digest", "n").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least != most")
    copies = written(ids.join(classes, ["digest", "n"]).where("key > least").select("key", "tie", "n").distinct(), "repeats-copies")
    texts = texts.join(few(copies.select("key", "tie")), ["key", "tie"], "left_anti")
    posted = _posted(texts, rule)
    often = posted.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1")
    met = posted.join(often, "hash").withColumn("hot", F.col("times") > rule.hot_runs).drop("times")
    met = written(met, "repeats-met")
    carried = written(_carried(texts, met, rule), "repeats-runs")
    found = _sorted_spans(carried, rule).unionByName(_hot_spans(carried, rule))
    found = found.unionByName(copies.select("key", "tie", F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
    found = found.groupBy("key", "tie").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    found = written(found, "repeats-spans")
    discard(ids, copies, met, carried)
    return found


def merged(found: np.ndarray) -> np.ndarray:
    """Sorted (start, end) rows as disjoint ones that do not touch."""
    if not len(found):
        return found
    reach = np.maximum.accumulate(found[:, 1])
    new = np.concatenate([[True], found[1:, 0] > reach[:-1]])
    return np.stack([found[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(found) - 1)]], axis=1)


def _span_rows(cell: pa.Scalar) -> np.ndarray:
    if not cell.is_valid:
        return np.zeros((0, 2), np.int64)
    found = cell.values
    return merged(np.stack([np.asarray(found.field("start")), np.asarray(found.field("end"))], axis=1))


def _rest(raw: bytes, found: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in found.tolist():
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def digests(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; found: what `spans` returns.

    A null or empty text has no bytes. Repeated rows give repeated results, an empty table gives an
    empty result, and further columns are ignored.
    """
    texts = _documents(docs, id_col, text_col).join(found, ["key", "tie"], "left").select("key", "text", "spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            removed, count, kept = [], [], []
            for k in range(batch.num_rows):
                rows = _span_rows(batch.column(2)[k])
                removed.append(int((rows[:, 1] - rows[:, 0]).sum()))
                count.append(len(rows))
                kept.append(hashlib.sha256(_rest(data[at[k] : at[k + 1]].tobytes(), rows)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    out = map_arrow(texts, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))


def _whole_characters(raw: bytes, found: np.ndarray) -> np.ndarray:
    """Spans cut back to whole characters of UTF-8."""
    out = []
    for a, b in found.tolist():
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def without_repeats(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """All rows and columns, with repeated bytes taken out of the text, as far as whole characters go.

    A text of which nothing is left is empty. The length column, if there is one, is counted anew
    for changed texts; null texts stay null.
    """
    found = spans(docs, rule, id_col, text_col).withColumnsRenamed({"key": "__key", "tie": "__tie", "spans": "__spans"})
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    on = (F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)) == F.col("__key")) & (F.xxhash64(text) == F.col("__tie"))
    both = docs.join(found, on, "left").select(*(f"`{c}`" for c in docs.columns), "__spans")
    names, schema = docs.columns, docs.schema
    where = names.index(text_col)
    length = names.index(count_col) if count_col in names else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:-1])
            texts = columns[where].to_pylist()
            counts = columns[length].to_pylist() if length is not None else []
            for k, cell in enumerate(batch.column(batch.num_columns - 1)):
                if cell.is_valid and texts[k]:
                    raw = texts[k].encode("utf-8", "surrogatepass")
                    texts[k] = _rest(raw, _whole_characters(raw, _span_rows(cell))).decode("utf-8", "surrogatepass")
                    if length is not None:
                        counts[k] = len(texts[k])
            columns[where] = pa.array(texts, columns[where].type)
            if length is not None:
                columns[length] = pa.array(counts, columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return map_arrow(both, run, schema)
