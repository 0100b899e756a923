"""Windows of digest history."""

from __future__ import annotations

import datetime as dt

from trendloom.operators import digests

AS_OF = dt.date(2024, 6, 30)


def runs(spark, *days_before):
    rows = [(AS_OF - dt.timedelta(days=n), n * 1.0, 10, n % 2 == 0, "low", ["a", "b", "c", "d"]) for n in days_before]
    return spark.createDataFrame(
        rows,
        "run_date DATE, top_engagement DOUBLE, tweet_count INT, notable BOOLEAN, signal_strength STRING, trends ARRAY<STRING>",
    )


def test_recent_digests_and_lines_end_at_the_as_of_day(spark):
    table = runs(spark, 40, 8, 7, 3, 1, 0, -1, -300)
    recent = digests.recent_digests(table, AS_OF).collect()
    assert [r.run_date for r in recent] == [AS_OF - dt.timedelta(days=n) for n in (0, 1, 3, 7)]
    lines = digests.context_lines(table, AS_OF, newest=2).collect()
    assert [r.run_date for r in lines] == [AS_OF, AS_OF - dt.timedelta(days=1)]
    assert {r.total_runs for r in lines} == {5}


def test_baseline_covers_thirty_days(spark):
    row = digests.baseline_stats(runs(spark, *range(-60, 60)), AS_OF).first()
    assert (row.total_runs, row.avg_top_engagement, row.notable_days) == (31, 15.0, 16)
