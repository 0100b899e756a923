"""Alignment of the tokens of two tokenizers by the bytes they stand for.

Tokenizer A is a byte-level BPE of the tokenizers library and reads a space and the text; tokenizer B
is a sentencepiece BPE with byte fallback, which adds that space itself. The character offsets of A
and the spans of sentencepiece's encoding (whose immutable proto is named `offset_mapping` in this
version) are coarse cuts; where a token's span is not as long as its decoded bytes - parts of a
character, byte-fallback tokens, the added space - its end is refined with these bytes.

Both tokenizers end a token before a single space between two characters that are no white space, and
neither joins anything over it. So texts are cut there, and equal words are encoded and aligned once.
A link is a pair of tokens of one group; documents are counted per pair of ids over the whole corpus.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trendloom.llm.common import map_arrow, slices, utf8, written

#: Texts of a block: what its documents link is looked up once for all of them.
BLOCK_BYTES = 4 << 20
#: Words whose alignment a worker keeps, in each of two generations.
KEPT_WORDS = 200_000
#: Pairs of a group that are listed one by one; beyond, its distinct ids are paired.
_LISTED_PAIRS = 1 << 14
_BITS = 24
_CUT = re.compile(r"(?<=\S) (?=\S)")
_UNEVEN = re.compile(r"\A | \Z|\s | \s")


def split(text: str) -> list[str]:
    """The words of a text: cut at single spaces between two characters that are no white space."""
    return _CUT.split(text) if _UNEVEN.search(text) else text.split(" ")


@cache
def _byte_of() -> dict[str, int]:
    """The byte that a character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """The bytes of every token id, and their lengths."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.lengths = np.array([len(t) for t in texts], np.int64)


def byte_level(tokenizer: Tokenizer) -> Vocabulary:
    byte = _byte_of()
    texts = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        texts[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return Vocabulary(texts)


def sentence_pieces(model: sentencepiece.SentencePieceProcessor) -> Vocabulary:
    pieces = [(model.id_to_piece(i), model.is_byte(i)) for i in range(model.get_piece_size())]
    return Vocabulary([bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces])


def refined(coarse_begin: np.ndarray, coarse_end: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Byte ends of the tokens of a text: a token's coarse end if its span has the length of its bytes,
    else the last such end (or the text's begin) and the bytes since then."""
    total = np.cumsum(lengths)
    exact = coarse_end - coarse_begin == lengths
    shift = np.where(exact, coarse_end - total, 0)
    known = np.maximum.accumulate(np.where(exact, np.arange(len(lengths)), 0))
    return total + shift[known]


class Aligner:
    """Words with their alignment: (groups as text, number of A and B tokens, groups and links, and the
    distinct id pairs with how often they are linked). None where a tokenizer changes the bytes."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.vocab_a, self.vocab_b = byte_level(self.a), sentence_pieces(self.b)
        self.size_a, self.size_b = len(self.vocab_a.texts), len(self.vocab_b.texts)
        names = [[b"%d" % i for i in range(n)] for n in (self.size_a, self.size_b)]
        marks = ((names[0], b","), (names[0], b"|"), (names[1], b","), (names[1], b";"))
        self.names = [name + mark for listed, mark in marks for name in listed]
        self.name_lengths = np.array([len(n) for n in self.names], np.int64)
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def words(self, words: list[str]) -> list[tuple | None]:
        """The alignments of distinct words; unseen ones are encoded together."""
        young, old = self.young, self.old
        found: dict[str, tuple | None] = {}
        for w in words:
            if w in young:
                found[w] = young[w]
            elif w in old:
                found[w] = young[w] = old[w]
        unseen = [w for w in words if w not in found]
        for low in range(0, len(unseen), 20_000):
            part = unseen[low : low + 20_000]
            for w, record in zip(part, self._aligned(part)):
                found[w] = record
                if len(w) <= 64:
                    young[w] = record
        if len(young) > KEPT_WORDS:
            self.old, self.young = young, {}
        return [found[w] for w in words]

    def _aligned(self, words: list[str]) -> list[tuple | None]:
        """Words without white space at their ends are encoded as one text; any other by itself."""
        records: list[tuple | None] = [None] * len(words)
        plain = [k for k, w in enumerate(words) if not (w[0].isspace() or w[-1].isspace())]
        alone = [[k] for k, w in enumerate(words) if w[0].isspace() or w[-1].isspace()]
        waiting = [plain, *alone] if plain else alone
        while waiting:
            part = waiting.pop()
            made = self._grouped([words[k] for k in part])
            if made is not None:
                for k, record in zip(part, made):
                    records[k] = record
            elif len(part) > 1:  # some word's bytes are changed: look for it in halves
                waiting += [part[: len(part) // 2], part[len(part) // 2 :]]
        return records

    def _grouped(self, words: list[str]) -> list[tuple] | None:
        text = " " + " ".join(words)
        raw = text.encode()
        encoded = self.a.encode(text, add_special_tokens=False)
        spans = self.b.encode(text[1:], return_type="offset_mapping", return_bytes=True)
        ids = encoded.ids, spans["ids"]
        if any(b"".join(map(v.texts.__getitem__, i)) != raw for v, i in zip((self.vocab_a, self.vocab_b), ids)):
            return None
        n = len(words)
        a_ids, b_ids = (np.array(i, np.int64) for i in ids)
        a_span, b_span = (
            np.fromiter(chain.from_iterable(offsets), np.int64, 2 * len(i)).reshape(-1, 2)
            for offsets, i in zip((encoded.offsets, spans["offsets"]), ids)
        )
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.concatenate(([0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))))
        sizes = np.fromiter(map(len, words), np.int64, n) + 1
        base = at[np.concatenate(([0], np.cumsum(sizes)))]
        a_end = refined(at[a_span[:, 0]], at[a_span[:, 1]], self.vocab_a.lengths[a_ids])
        b_end = refined(b_span[:, 0] + 1, b_span[:, 1] + 1, self.vocab_b.lengths[b_ids])
        a_count, b_count = (np.diff(np.searchsorted(end, base, "right")) for end in (a_end, b_end))

        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        in_a, in_b = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
        a_stop, b_stop = np.cumsum(in_a), np.cumsum(in_b)
        word_of = np.searchsorted(base, cuts, "left") - 1
        n_groups = np.bincount(word_of, minlength=n)
        links = in_a * in_b
        n_links = np.bincount(word_of, links, n).astype(np.int64)

        order = np.empty(len(a_ids) + len(b_ids), np.int64)
        order[np.arange(len(a_ids)) + (b_stop - in_b)[a_group]] = a_ids + np.where(np.isin(a_end, cuts), self.size_a, 0)
        order[np.arange(len(b_ids)) + a_stop[b_group]] = 2 * self.size_a + b_ids + np.where(np.isin(b_end, cuts), self.size_b, 0)
        shown = b"".join(map(self.names.__getitem__, order.tolist()))
        shown_at = np.concatenate(([0], np.cumsum(self.name_lengths[order])))[np.concatenate(([0], np.cumsum(a_count + b_count)))]

        small = links[a_group] <= _LISTED_PAIRS
        reach = np.where(small, in_b[a_group], 0)
        left = np.repeat(np.arange(len(a_ids)), reach)
        right = np.arange(len(left)) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat((b_stop - in_b)[a_group], reach)
        words_of = word_of[a_group[left]]
        keys = (a_ids[left] << _BITS) | b_ids[right]
        times = np.ones(len(keys), np.int64)
        for g in np.flatnonzero(links > _LISTED_PAIRS):
            left_ids, left_n = np.unique(a_ids[a_stop[g] - in_a[g] : a_stop[g]], return_counts=True)
            right_ids, right_n = np.unique(b_ids[b_stop[g] - in_b[g] : b_stop[g]], return_counts=True)
            keys = np.concatenate((keys, ((left_ids[:, None] << _BITS) | right_ids).ravel()))
            times = np.concatenate((times, (left_n[:, None] * right_n).ravel()))
            words_of = np.concatenate((words_of, np.full(len(left_ids) * len(right_ids), word_of[g])))
        sort = np.lexsort((keys, words_of))
        keys, words_of, times = keys[sort], words_of[sort], times[sort]
        first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (words_of[1:] != words_of[:-1]))))
        keys, times, words_of = keys[first], np.add.reduceat(times, first), words_of[first]
        key_at = np.searchsorted(words_of, np.arange(n + 1)) * 8
        key_bytes, time_bytes = keys.tobytes(), times.tobytes()
        numbers = zip(a_count.tolist(), b_count.tolist(), n_groups.tolist(), n_links.tolist())
        return [
            (shown[s0:s1], *four, key_bytes[k0:k1], time_bytes[k0:k1])
            for s0, s1, four, k0, k1 in zip(shown_at.tolist(), shown_at[1:].tolist(), numbers, key_at.tolist(), key_at[1:].tolist())
        ]


@cache
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _packed(pairs: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending places and counts in as few bytes as they need; unpacked by ``_unpacked``."""
    steps = np.diff(pairs, prepend=0)
    step_type = np.uint16 if not len(steps) or steps.max() < 1 << 16 else np.uint32
    time_type = np.uint8 if not len(times) or times.max() < 1 << 8 else np.uint64
    return steps.astype(step_type).tobytes(), times.astype(time_type).tobytes()


def _unpacked(steps: bytes, times: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    step_type = np.uint16 if len(steps) == 2 * n else np.uint32
    time_type = np.uint8 if len(times) == n else np.uint64
    return np.cumsum(np.frombuffer(steps, step_type).astype(np.int64)), np.frombuffer(times, time_type).astype(np.int64)


class Block:
    """Documents that are aligned together: their digests, and the id pairs each of them links."""

    def __init__(self, aligner: Aligner, texts: list[str]):
        parts = [split(t) if t else [] for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        place = {w: k for k, w in enumerate(dict.fromkeys(w for p in parts for w in p))}
        records = aligner.words(list(place))
        bad = np.array([r is None for r in records], bool)
        shown, numbers, keys, times = [], np.zeros((len(records) + 1, 4), np.int64), [], []
        for k, r in enumerate(records):
            text, *four, key_bytes, time_bytes = r or (b"", 0, 0, 0, 0, b"", b"")
            shown.append(text)
            numbers[k] = four
            keys.append(key_bytes)
            times.append(time_bytes)
        pair_n = np.array([len(k) >> 3 for k in keys], np.int64)
        pair_at = np.cumsum(pair_n) - pair_n
        self.keys, pair = np.unique(np.frombuffer(b"".join(keys), np.int64), return_inverse=True)
        weight = np.frombuffer(b"".join(times), np.int64)
        codes = np.fromiter((place[w] for p in parts for w in p), np.int64, int(sizes.sum()))
        stops = np.cumsum(sizes)
        self.rows = []
        self.documents = np.zeros(len(self.keys), np.int64)
        for stop, size in zip(stops.tolist(), sizes.tolist()):
            own = codes[stop - size : stop]
            if not size or bad[own].any():
                self.rows.append((0, 0, 0, 0, "", 0, b"", b""))
                continue
            digest = hashlib.sha256()
            for low in range(0, size, 100_000):
                last = low + 100_000 >= size
                listed = b"".join(map(shown.__getitem__, own[low : low + 100_000].tolist()))
                digest.update(listed[:-1] if last else listed)
            distinct, often = np.unique(own, return_counts=True)
            reach = pair_n[distinct]
            spot = np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat(pair_at[distinct], reach)
            linked, back = np.unique(pair[spot], return_inverse=True)
            linked_n = np.zeros(len(linked), np.int64)
            np.add.at(linked_n, back, weight[spot] * np.repeat(often, reach))
            self.documents[linked] += 1
            totals = (numbers[distinct] * often[:, None]).sum(axis=0).tolist()
            self.rows.append((*totals, digest.hexdigest(), len(linked), *_packed(linked, linked_n)))


_MADE = [
    ("block", "long", pa.int64()), ("doc_id", "long", pa.int64()), ("n_a", "long", pa.int64()), ("n_b", "long", pa.int64()),
    ("n_groups", "long", pa.int64()), ("n_links", "long", pa.int64()), ("groups_sha256", "string", pa.string()),
    ("n_pairs", "long", pa.int64()), ("steps", "binary", pa.binary()), ("times", "binary", pa.binary()),
    ("keys", "array<long>", pa.list_(pa.int64())), ("documents", "array<long>", pa.list_(pa.int64())),
]


def aligned(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per document with its digests and the pairs it links, as places in the sorted list of its
    block; and a row per block with this list (keys) and the block's documents of each pair."""

    size = BLOCK_BYTES

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, at = utf8(batch.column(1))
            ids = batch.column(0).cast(pa.int64()).to_pylist()
            for low, high in slices(at, size):
                made = Block(aligner, [t or "" for t in batch.column(1).slice(low, high - low).to_pylist()])
                rows = [(block, doc_id, *row, None, None) for doc_id, row in zip(ids[low:high], made.rows)]
                rows.append((block, None, *[None] * 4, None, None, None, None, made.keys, made.documents))
                columns = [pa.array(c, kind) for c, (_, _, kind) in zip(zip(*rows), _MADE)]
                yield pa.RecordBatch.from_arrays(columns, names=[n for n, _, _ in _MADE])
                block += 1

    schema = ", ".join(f"{name} {kind}" for name, kind, _ in _MADE)
    return map_arrow(documents.select("doc_id", "text"), run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """key, n (documents that hold the pair linked), best (no pair of its A id has more)."""
    totals = blocks.groupBy("key").agg(F.sum("documents").alias("n"))
    totals = written(totals, "align-pairs")
    a_id = F.shiftright("key", _BITS).alias("a")
    highest = totals.groupBy(a_id).agg(F.max("n").alias("top"))  # a row per id of A's vocabulary, at most
    rated = totals.select("key", "n", a_id).join(F.broadcast(highest), "a")
    return rated.select("key", "n", (F.col("n") == F.col("top")).alias("best"))


def _finished(stream: DataFrame) -> DataFrame:
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kinds = [*[pa.int64()] * 7, pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            columns = batch.to_pydict()
            rates = batch.column(batch.schema.get_field_index("rates"))
            out = []
            for k, kind in enumerate(columns["kind"]):
                if kind == 0:
                    rate = rates[k].values.to_numpy()
                    n, best = rate >> 1, rate & 1
                    continue
                linked, often = _unpacked(columns["steps"][k], columns["times"][k], columns["n_pairs"][k])
                four = [columns[c][k] for c in names[:5]]
                out.append((*four, int((often * best[linked]).sum()), int((often * n[linked]).sum()), columns["groups_sha256"][k]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    schema = ", ".join(f"{name} {'string' if name == names[-1] else 'long'}" for name in names)
    return map_arrow(stream, run, schema)


def alignments(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per row of documents: doc_id, tokens, groups and links of its text, the links whose pair
    is its A id's most frequent one, the sum of their counts, and a digest of the groups.

    A null or empty text, or one whose bytes a tokenizer changes, has zeros and an empty digest; a null
    id stays, repeated rows count as documents, further columns are ignored, an empty table gives an
    empty result. Pairs meet their counts once per block of documents, not once per document, and a
    block's counts (as many as it has distinct pairs) pass its documents in one stream. Words are
    aligned whole; a text without a space between words is encoded at once.
    """
    made = written(aligned(documents, path_a, path_b), "align-blocks")
    zipped = F.arrays_zip(F.col("keys").alias("key"), F.col("documents").alias("documents"))
    blocks = made.where("keys is not null").select("block", F.explode(zipped).alias("p")).select("block", "p.key", "p.documents")
    met = blocks.select("block", "key").join(pair_counts(blocks), "key")
    rate = F.col("n") * 2 + F.col("best").cast("long")
    rates = met.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("key", rate.alias("rate")))).alias("r"))
    none = {c: F.lit(None).cast(kind).alias(c) for c, kind, _ in _MADE}
    shown = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "steps", "times"]
    heads = rates.select("block", F.lit(0).alias("kind"), F.col("r.rate").alias("rates"), *(none[c] for c in shown))
    rows = made.where("keys is null").select("block", F.lit(1).alias("kind"), F.lit(None).cast("array<long>").alias("rates"), *shown)
    stream = heads.union(rows).repartition("block").sortWithinPartitions("block", "kind")
    return _finished(stream.drop("block"))


def groups(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, groups: for each group of a text its first and last byte (end exclusive, the added space
    included) and its A and B ids; null where a tokenizer changes the bytes, empty for no text."""
    group = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = split(text) if text else []
                known = dict(zip(dict.fromkeys(words), aligner.words(list(dict.fromkeys(words)))))
                found, at = [], 0
                for part in () if None in known.values() else (known[w] for w in words):
                    for shown in part[0].decode().rstrip(";").split(";"):
                        a, b = ([int(i) for i in side.split(",")] for side in shown.split("|"))
                        end = at + int(aligner.vocab_a.lengths[a].sum())
                        found.append({"start": at, "end": end, "a": a, "b": b})
                        at = end
                out.append(None if None in known.values() else found)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.list_(group))], names=["doc_id", "groups"])

    schema = "doc_id long, groups array<struct<start: long, end: long, a: array<long>, b: array<long>>>"
    return map_arrow(documents.select("doc_id", "text"), run, schema)
