"""Batches for Python are bounded in bytes, not only in rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from trendloom.llm import common


def test_batches_are_bounded_in_bytes(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["n", "rows"])

    long = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    got = common.map_arrow(long, run, "n long, rows long").collect()
    assert sum(r.rows for r in got) == 4000
    assert max(r.n for r in got) <= common.BATCH_BYTES + 20_000
