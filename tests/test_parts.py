"""Stream queries over a documents table that is a folder of parts, as large tables are."""

from __future__ import annotations

import shutil
from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from tests.compare import compare, connect
from tests.conftest import SF_SMALL
from trendloom.plans import testdata as td
from trendloom.plans.catalog import ORACLES

STREAMS = (
    "stream_daily_counts", "stream_deduplicated", "stream_hot_terms", "stream_ingested_activity",
    "stream_quoted_mentions", "stream_sliding_scores", "stream_topic_engagement",
)


@pytest.fixture(scope="module")
def in_parts(spark, tmp_path_factory):
    """The smallest tables, documents in three files."""
    folder = tmp_path_factory.mktemp("parts")
    for file in Path(SF_SMALL).glob("*.parquet"):
        if file.name != "documents.parquet":
            shutil.copy(file, folder)
    td.table(spark, SF_SMALL, "documents").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", STREAMS)
def test_streams_read_all_parts(spark, in_parts, name):
    df = entry_module.queries()[name](spark, in_parts)
    assert compare(df, connect(SF_SMALL), ORACLES[name]) is None
