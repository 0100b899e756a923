from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trendloom.functions import scoring


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def lit(*values):
    return [F.lit(v) for v in values]


def test_engagement(spark):
    assert one(spark, scoring.engagement(*lit(100, 50, 30))) == 134.0
    assert one(spark, scoring.engagement_tenths(*lit(2_000_000_000, 0, 1))) == 20_000_000_003


def test_velocity(spark):
    assert one(spark, scoring.velocity_score(*lit(100.0, 5, 10))) == 200.0
    assert one(spark, scoring.velocity_score(*lit(100.0, 0, 0))) == 100.0


@pytest.mark.parametrize(
    ("ratio", "factor"), [(0.0, 0.01), (0.39, 0.205), (0.4, 0.54), (0.69, 0.7865), (0.7, 1.29), (1.0, 1.5)]
)
def test_context_multiplier(spark, ratio, factor):
    assert one(spark, scoring.context_multiplier(F.lit(ratio))) == pytest.approx(factor)


def test_composite(spark):
    score = scoring.composite_score(*lit(10, 200.0, 1.0, 1.0))
    assert one(spark, score) == pytest.approx((2 + 160) * 1.5 * 1.5)


@pytest.mark.parametrize(
    ("row", "passes"),
    [
        (("cashtag", 10, 1.0, 0.0, 5.0), True),
        (("cashtag", 9, 1.0, 0.0, 5.0), False),
        (("hashtag", 15, 0.64, 0.5, 5.0), False),
        (("ngram", 15, 0.9, 0.1, 5.0), True),
        (("ngram", 15, 0.9, 0.05, 50000.0), False),
        (("ngram", 15, 0.95, 0.05, 20001.0), True),
        (("ngram", 15, 0.95, 0.05, 20000.0), False),
    ],
)
def test_quality(spark, row, passes):
    assert one(spark, scoring.passes_quality(*lit(*row))) is passes


@pytest.mark.parametrize(
    ("top", "n", "baseline", "signal"),
    [
        (10000.0, 0, 5000.0, "none"), (50000.0, 5, 5000.0, "high"), (15000.0, 3, 5000.0, "medium"),
        (4000.0, 2, 5000.0, "low"), (2000.0, 1, 5000.0, "none"), (50000.0, 2, 5000.0, "medium"),
        (100.0, 5, 5000.0, "medium"), (10.0, 3, 0.0, "high"),
    ],
)
def test_signal(spark, top, n, baseline, signal):
    assert one(spark, scoring.signal_strength(F.lit(top), F.lit(n), baseline)) == signal


@pytest.mark.parametrize(
    ("appearances", "days", "gap", "badge"),
    [
        (1, 0, None, "New"), (4, 4, 1, "Day 4"), (2, 2, 1, "Day 2"), (3, 1, 30, "Last seen 30d ago"),
        (3, 1, 200, "Last seen 6mo ago"), (3, 1, 5, ""), (3, 1, 14, "Last seen 14d ago"),
    ],
)
def test_badge(spark, appearances, days, gap, badge):
    gap_col = F.lit(gap).cast("int")
    assert one(spark, scoring.temporal_badge(F.lit(appearances), F.lit(days), gap_col)) == badge


@pytest.mark.parametrize(
    ("today", "mean", "label"),
    [(5, None, "emerging"), (16, 10.0, "accelerating"), (15, 10.0, "stable"), (4, 10.0, "declining")],
)
def test_trajectory(spark, today, mean, label):
    assert one(spark, scoring.trajectory(F.lit(today), F.lit(mean).cast("double"))) == label


def test_calendar(spark):
    day = one(spark, scoring.calendar_context(F.lit("2024-01-20").cast("date")))
    assert day.asDict() == {"weekday_name": "Saturday", "is_weekend": True, "is_early_quarter": True}
    day = one(spark, scoring.calendar_context(F.lit("2024-04-22").cast("date")))
    assert day.asDict() == {"weekday_name": "Monday", "is_weekend": False, "is_early_quarter": False}


def test_match_band(spark):
    bands = [one(spark, scoring.match_band(F.lit(s))) for s in (0.8, 0.75, 0.61, 0.6)]
    assert bands == ["strong", "moderate", "moderate", None]
