from __future__ import annotations

import datetime as dt

import pytest

from trendloom.operators import health

SCHEMA = """run_id LONG, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, broad_posts INT, deep_dive_posts INT,
  trends_discovered INT, sources_active INT, sources_total INT, report_sent BOOLEAN, errors ARRAY<STRING>,
  warnings ARRAY<STRING>"""
START = dt.datetime(2024, 1, 1, 8)


def run(spark, seconds=90, **changes):
    row = {
        "run_id": 1, "start_time": START, "end_time": START + dt.timedelta(seconds=seconds),
        "broad_posts": 300, "deep_dive_posts": 200, "trends_discovered": 5, "sources_active": 4,
        "sources_total": 5, "report_sent": True, "errors": [], "warnings": [],
    }
    row.update(changes)
    df = spark.createDataFrame([tuple(row.values())], SCHEMA)
    return health.run_health(df).first()


@pytest.mark.parametrize(
    ("changes", "severity", "reason"),
    [
        ({}, "ok", "All systems operational"),
        ({"broad_posts": 0, "deep_dive_posts": 0}, "critical", "Zero posts collected"),
        ({"sources_active": 0}, "critical", "All sources unavailable"),
        ({"errors": ["a", "b"], "report_sent": False}, "critical", "2 error(s) occurred"),
        ({"errors": ["a"]}, "ok", "All systems operational"),
        ({"warnings": ["[08:00:00] Failed to store memory: x", "y"]}, "warning", "Memory storage failed - 1 failure(s)"),
        ({"broad_posts": 20, "deep_dive_posts": 10}, "warning", "Very low post count (30)"),
        ({"trends_discovered": 0}, "warning", "No trends discovered"),
        ({"sources_active": 1}, "warning", "Only 1/5 sources active"),
    ],
)
def test_alerts(spark, changes, severity, reason):
    row = run(spark, **changes)
    assert (row.alert, row.severity, row.reason) == (severity != "ok", severity, reason)


@pytest.mark.parametrize(("seconds", "label"), [(45, "45.0s"), (90, "1.5m"), (5400, "1.5h")])
def test_duration(spark, seconds, label):
    assert run(spark, seconds).duration == label


def test_warnings(spark):
    assert not run(spark).has_warnings
    assert run(spark, broad_posts=50, deep_dive_posts=49).has_warnings
    assert run(spark, sources_active=2).has_warnings
    assert run(spark, warnings=["w"]).has_warnings


def test_ingest_status(spark):
    log = [("a", 1, 0), ("a", 2, 3), ("b", 1, 0), ("b", 2, 0), ("b", 3, 0)]
    log += [("c", i, 0) for i in range(4)]
    rows = [(dt.date(2024, 1, 1), *r) for r in log]
    df = spark.createDataFrame(rows, "run_date DATE, topic STRING, attempt INT, n_posts INT")
    got = {r.topic: r.status for r in health.ingest_status(df).collect()}
    assert got == {"a": "complete", "b": "retry", "c": "complete_empty"}
