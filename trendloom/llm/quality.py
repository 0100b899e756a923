"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are counted over whole texts: one over all documents, one
over the trusted ones. A text's score is the mean, over its n-grams, of the logarithm of how much
likelier the n-gram is among trusted texts. The trusted counts are smoothed towards those of all
documents, so an n-gram that either has hardly seen says nothing.

Logarithms are whole multiples of 2**-20 and are added as integers: a score doesn't depend on how
texts are dealt to tasks, and every document is held to the same threshold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import BLOCK, PLAIN, SPACE, U64, byte_set, map_arrow, mixed, slices, utf8, words

_UNIT = 1 << 20
_SYMBOLS = byte_set(b"#*$%&|<>")
_BLANK = " \t\n\x0b\x0c\r"
#: Parts over which the rows of one id are spread.
_SALTS = 8


@dataclass(frozen=True)
class Rule:
    """Parameters: bytes of an n-gram, hash buckets (as bits), weight of the smoothing, threshold.

    A text is kept from a mean of `least` on: at -0.5, one whose n-grams are not less likely among
    trusted texts by more than a factor of 0.6 each. The base rules need `min_words` words, at most
    `max_repeated` percent of them in repeated three-word windows.
    """

    n: int = 4
    bits: int = 16
    smoothing: int = 8192
    least: float = -0.5
    min_words: int = 50
    max_repeated: int = 50


DEFAULT = Rule()


def _buckets(data: np.ndarray, rule: Rule) -> np.ndarray:
    """The bucket of the n-gram that begins at each byte but the last n - 1."""
    m = len(data) - rule.n + 1
    h = np.zeros(max(m, 0), U64)
    for j in range(rule.n if m > 0 else 0):
        h = h * U64(257) + data[j : j + m].astype(U64)
    return ((h * U64(0x9E3779B97F4A7C15)) >> U64(64 - rule.bits)).astype(np.int64)


def _blocks(data: np.ndarray, at: np.ndarray, rule: Rule) -> Iterator[tuple[int, np.ndarray]]:
    """The buckets of consecutive texts by blocks of bytes: where a block begins, and its buckets."""
    low, last = int(at[0]), int(at[-1])
    while low < last:
        yield low, _buckets(data[low : min(low + BLOCK, last) + rule.n - 1][: last - low], rule)
        low += BLOCK


def _counted(at: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Where the n-grams of each text begin: from, to."""
    return at[:-1], np.maximum(at[:-1], at[1:] - rule.n + 1)


def counts(documents: DataFrame, labels: DataFrame, rule: Rule = DEFAULT) -> DataFrame:
    """bucket, n_all, n_trusted over the whole texts of all documents.

    Trusted are documents with a label row of quality 1. Texts meet the trusted ids in one shuffle, at
    every size, without a sort; an id on many rows, null too, is spread by their texts. A task then
    adds its texts up and passes on a row per bucket.
    """
    trusted = labels.where("quality = 1").select(F.col("doc_id").alias("_trusted")).distinct()
    copies = trusted.select("_trusted", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_copy"))
    salted = documents.select("doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(_SALTS)).cast("int").alias("_salt"))
    met = (F.col("doc_id") == F.col("_trusted")) & (F.col("_salt") == F.col("_copy"))
    flagged = salted.join(copies.hint("shuffle_hash"), met, "left")
    size = 1 << rule.bits

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size), np.int64)
        for batch in batches:
            data, at = utf8(batch.column(0))
            chosen = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for low, high in slices(at):
                part = at[low : high + 1]
                begin, end = _counted(part, rule)
                for start, bucket in _blocks(data, part, rule):
                    edges = np.zeros((2, len(bucket) + 1), np.int64)
                    for row, of in enumerate((slice(None), chosen[low:high])):
                        first, final = (np.clip(x[of] - start, 0, len(bucket)) for x in (begin, end))
                        edges[row] = np.bincount(first, minlength=len(bucket) + 1) - np.bincount(final, minlength=len(bucket) + 1)
                        sums[row] += np.bincount(bucket[np.cumsum(edges[row][:-1]) > 0], minlength=size)
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(sums[0][used]), pa.array(sums[1][used])], names=["bucket", "n_all", "n_trusted"]
        )

    flags = flagged.select("text", F.col("_trusted").isNotNull().alias("trusted"))
    parts = map_arrow(flags, run, "bucket long, n_all long, n_trusted long")
    return parts.groupBy("bucket").agg(F.sum("n_all").alias("n_all"), F.sum("n_trusted").alias("n_trusted"))


def log_ratios(bucket: np.ndarray, n_all: np.ndarray, n_trusted: np.ndarray, rule: Rule = DEFAULT) -> np.ndarray:
    """Logarithms of trusted over raw likelihood by bucket, in units of 2**-20."""
    size = 1 << rule.bits
    raw, target = np.zeros(size), np.zeros(size)
    raw[bucket], target[bucket] = n_all, n_trusted
    share = (raw + 1) / (raw.sum() + size)
    smooth = (target + rule.smoothing * share) / (target.sum() + rule.smoothing)
    return np.round((np.log(smooth) - np.log(share)) * _UNIT).astype(np.int64)


def fit(documents: DataFrame, labels: DataFrame, rule: Rule = DEFAULT) -> np.ndarray:
    """The log ratios of all buckets. At most 2**bits rows of counts come to the driver."""
    rows = counts(documents, labels, rule).toPandas()
    return log_ratios(*(rows[c].to_numpy(np.int64) for c in ("bucket", "n_all", "n_trusted")), rule)


def likelihoods(data: np.ndarray, at: np.ndarray, ratios: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log ratios and number of n-grams of consecutive texts."""
    begin, end = _counted(at, rule)
    sums = np.zeros(len(begin), np.int64)
    for start, bucket in _blocks(data, at, rule):
        total = np.concatenate(([0], np.cumsum(ratios[bucket])))
        sums += total[np.clip(end - start, 0, len(bucket))] - total[np.clip(begin - start, 0, len(bucket))]
    return sums, end - begin


def repeated_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of consecutive texts, and how many stand in a three-word window found twice."""
    first, _, (hashes,) = words(data, at, SPACE, fold=PLAIN)
    n_words = np.diff(first)
    total = len(hashes)
    cover = np.zeros(total + 1, np.int64)
    if total > 2:
        text_of = np.repeat(np.arange(len(n_words)), n_words)
        inside = np.flatnonzero(text_of[2:] == text_of[:-2])
        key = mixed(mixed(mixed(hashes[inside]) + hashes[inside + 1]) + hashes[inside + 2])
        key = mixed(key + text_of[inside].astype(U64))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        for shift in range(3):
            cover[inside[again] + shift] = 1
    sums = np.concatenate(([0], np.cumsum(cover[:total])))
    return n_words, sums[first[1:]] - sums[first[:-1]]


def repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(_BLANK)]
    return len(lines) - len(set(lines))


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_ngrams", "score", "base_failed", "kept")
_KINDS = (*[pa.int64()] * 6, pa.float64(), pa.bool_(), pa.bool_())
_TYPES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_ngrams long, score double, base_failed boolean, kept boolean"


def measured(text: pa.Array, ratios: np.ndarray, rule: Rule = DEFAULT) -> list[pa.Array]:
    """The columns of ``judged`` for a column of texts."""
    data, at = utf8(text)
    parts = []
    for low, high in slices(at):
        part = at[low : high + 1]
        block = data[part[0] : part[-1]]
        edges = part - part[0]
        n_words, n_repeat = repeated_words(data, part)
        marks = (~SPACE[block] & ((block & 0xC0) != 0x80), _SYMBOLS[block])
        chars, symbols = (np.diff(np.concatenate(([0], np.cumsum(m)))[edges]) for m in marks)
        lines = [repeated_lines(t or "") for t in text.slice(low, high - low).to_pylist()]
        sums, n = likelihoods(data, part, ratios, rule)
        failed = (n_words < rule.min_words) | (100 * n_repeat > rule.max_repeated * n_words)
        kept = ~failed & (sums >= round(rule.least * _UNIT) * n)
        parts.append((n_words, chars, symbols, lines, n_repeat, n, sums / np.maximum(n, 1) / _UNIT, failed, kept))
    if not parts:
        return [pa.array([], k) for k in _KINDS]
    return [pa.array(np.concatenate(column), k) for column, k in zip(zip(*parts), _KINDS)]


def judged(documents: DataFrame, ratios: np.ndarray, rule: Rule = DEFAULT) -> DataFrame:
    """One row per row of documents: doc_id, its counts, its score and whether it is kept.

    A null or empty text has no words, fails the base rules and scores 0; a text of fewer bytes than
    an n-gram scores 0. Repeated rows and ids are judged row by row, a null id stays, further columns
    are ignored, and an empty table gives an empty result. Nothing is shuffled.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(0).cast(pa.int64()), *measured(batch.column(1), ratios, rule)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *_NAMES])

    return map_arrow(documents.select("doc_id", "text"), run, f"doc_id long, {_TYPES}")


def keep_good(documents: DataFrame, ratios: np.ndarray, rule: Rule = DEFAULT) -> DataFrame:
    """The rows that ``judged`` keeps, with all their columns."""
    place = documents.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.fill_null(measured(batch.column(place), ratios, rule)[-1], False))

    return map_arrow(documents, run, documents.schema)
