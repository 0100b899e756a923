"""Every named query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from tests.compare import compare, connect
from tests.conftest import SF_SMALL
from trendloom.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = entry_module.queries()[name](spark, SF_SMALL)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() == 10


def test_only_hashed_features_lack_sql():
    assert set(QUERIES) - set(ORACLES) == {"embedded_memories"}
