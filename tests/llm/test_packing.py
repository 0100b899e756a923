from __future__ import annotations

import zlib

import numpy as np
import pytest
from tests.llm.data import ROWS, documents, empty
from tests.llm.test_bpe import PATH, ids_of

from trendloom.llm import packing


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4095, 4096, 4097, 12_345])
def test_piece_lengths(n):
    lengths = packing.piece_lengths(n)
    assert sum(lengths) == n
    assert all(x & (x - 1) == 0 and x <= 4096 for x in lengths)
    assert sorted(lengths, reverse=True) == lengths
    assert len(set(x for x in lengths if x < 4096)) == len([x for x in lengths if x < 4096])


def test_pack(spark):
    pieces = packing.pack(documents(spark), PATH)
    rows = packing.digests(pieces).collect()
    want = []
    for doc_id, text, *_ in ROWS:
        ids = [*ids_of(text or ""), 2]
        start = 0
        for length in packing.piece_lengths(len(ids)):
            raw = np.array(ids[start : start + length], "<u4").tobytes()
            want.append((doc_id, start, length, zlib.crc32(raw), len(ids)))
            start += length
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert all(r["offset"] == 0 and r["sequence_id"] >> 58 == r["bucket"] for r in rows)
    assert packing.pack(empty(spark), PATH).count() == 0


def test_buckets_hold_one_length(spark, tmp_path):
    packing.write_buckets(packing.pack(documents(spark), PATH), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.where("length != shiftleft(1, bucket)").count() == 0
    assert back.where("octet_length(tokens) != 4 * length").count() == 0


def test_max_length_is_a_power_of_two(spark):
    with pytest.raises(ValueError):
        packing.pack(documents(spark), PATH, max_length=1000)
