from __future__ import annotations

import datetime as dt

from trendloom.operators import authors
from trendloom.session import work_folder

DAY = dt.datetime(2024, 1, 1)


def rows(spark, *spans):
    """Mentions of a term by authors low to high on a day: (key, day, low, high)."""
    data = [(key, f"u{i}", DAY + dt.timedelta(days=day)) for key, day, low, high in spans for i in range(low, high)]
    return spark.createDataFrame(data, "key STRING, username STRING, created_at TIMESTAMP_NTZ")


def between(spark, path, first, last):
    found = authors.authors_between(authors.read_sketches(spark, path), DAY.date() + dt.timedelta(first), DAY.date() + dt.timedelta(last))
    return {r.trend_term: (r.active_days, r.authors) for r in found.collect()}


def test_days_are_united(spark):
    path = work_folder(spark, "sketches")
    authors.store_sketches(authors.daily_sketches(rows(spark, ("Gold", 0, 0, 30), ("$GOLD", 1, 20, 50), ("gold", 5, 0, 60), ("Oil", 1, 0, 2))), path)
    assert between(spark, path, 0, 1) == {"gold": (2, 50), "oil": (1, 2)}
    assert between(spark, path, 0, 9)["gold"] == (3, 60)
    assert between(spark, path, 7, 9) == {}


def test_a_day_is_replaced(spark):
    path = work_folder(spark, "sketches")
    authors.store_sketches(authors.daily_sketches(rows(spark, ("Gold", 0, 0, 30), ("Gold", 1, 0, 5))), path)
    authors.store_sketches(authors.daily_sketches(rows(spark, ("Gold", 0, 100, 110))), path)
    assert between(spark, path, 0, 0) == {"gold": (1, 10)}
    assert between(spark, path, 0, 1) == {"gold": (2, 15)}


def test_error_of_many_authors(spark):
    path = work_folder(spark, "sketches")
    authors.store_sketches(authors.daily_sketches(rows(spark, *[("Gold", day, day * 5000, day * 5000 + 10_000) for day in range(5)])), path)
    days, found = between(spark, path, 0, 4)["gold"]
    assert days == 5 and abs(found - 30_000) < 3 * 0.0163 * 30_000


def test_missing_authors_count_nothing(spark):
    path = work_folder(spark, "sketches")
    df = spark.createDataFrame([("Gold", None, DAY), ("Gold", "u", DAY)], "key STRING, username STRING, created_at TIMESTAMP_NTZ")
    authors.store_sketches(authors.daily_sketches(df), path)
    assert between(spark, path, 0, 0) == {"gold": (1, 1)}
