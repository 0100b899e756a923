"""Packing by power-of-two decomposition: binary-length pieces in buckets of equal length."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trendloom.llm.bpe import LONG_PIECE, WordIds, byte_characters, encoded, merges
from trendloom.llm.common import ids_of, map_arrow

MAX_LENGTH = 4096
END_ID = 2


def piece_lengths(n: int, most: int = MAX_LENGTH) -> list[int]:
    """As many of the greatest length as fit, then the binary digits of the rest, falling."""
    whole, rest = divmod(n, most)
    return [most] * whole + [1 << b for b in range(most.bit_length() - 1, -1, -1) if rest >> b & 1]


class LibraryWordIds(WordIds):
    """Ids of words from the tokenizers library, kept like those of the encoder."""

    def __init__(self, path: str):
        super().__init__(merges(path))
        self.tokenize = Tokenizer.from_file(path).model.tokenize
        self.chars = byte_characters()

    def piece(self, text: str) -> bytes:
        raw = text.encode("utf-8", "surrogatepass")
        if len(raw) >= LONG_PIECE:
            return super().piece(text)
        shown = "".join(map(self.chars.__getitem__, raw))
        ids = [token.id for token in self.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)


@cache
def _library_words(path: str) -> LibraryWordIds:
    return LibraryWordIds(path)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_length: int = MAX_LENGTH,
    end_id: int = END_ID,
) -> DataFrame:
    """Cut every tokenized document into pieces whose lengths are powers of two.

    One row per piece: doc_id, start (ids of the document before it), length, tokens (binary,
    little-endian 32-bit ids), doc_tokens (with the end id), bucket (binary logarithm of the
    length), sequence_id, offset. Every piece is a sequence of its own, so that none holds two
    documents and none needs padding; a bucket holds sequences of one length, ready for batches
    of equal shape, and its sequence ids are one range. `write_buckets` lays them out in folders.

    Ids are those of the tokenizers library for the file, then end_id; words seen before come from
    a bounded cache. A null
    or empty text is the end id alone. Repeated rows are packed each by itself, a null id stays
    null, an empty table gives an empty result, and columns beside the two named are ignored.
    Rows are cut where they are read; nothing is shuffled.
    """
    if max_length & (max_length - 1) or max_length < 1:
        raise ValueError("max_length is a power of two")
    end = end_id.to_bytes(4, "little")
    most = 4 << 20

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "tokens", "doc_tokens", "bucket"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        words = _library_words(tokenizer_path)
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoded(text.as_py(), tokenizer_path, words) + end
                total, start = len(ids) // 4, 0
                for length in piece_lengths(total, max_length):
                    rows.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], total, length.bit_length() - 1))
                    start += length
                held += len(ids)
                if held > most:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    pieces = map_arrow(
        ids_of(docs, id_col, text_col), cut, "doc_id long, start long, length long, tokens binary, doc_tokens long, bucket int"
    )
    in_bucket = F.col("bucket").cast("long") * F.lit(1 << 58)
    return pieces.withColumn("sequence_id", in_bucket + F.monotonically_increasing_id()).withColumn(
        "offset", F.lit(0).cast("long")
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write sequences into a folder per length."""
    pieces.write.mode("errorifexists").partitionBy("bucket").parquet(path)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their tokens."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )
