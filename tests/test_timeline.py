from __future__ import annotations

import datetime as dt
import random

from trendloom.operators import timeline

AS_OF = dt.date(2024, 6, 30)


def day(n: int) -> dt.date:
    return AS_OF - dt.timedelta(days=n)


def today(spark, *terms):
    rows = [(t, 10, 5.0, dt.datetime(2024, 6, 30, 8), dt.datetime(2024, 6, 30, 9)) for t in terms]
    return spark.createDataFrame(
        rows, "trend STRING, mentions INT, engagement DOUBLE, first_seen TIMESTAMP_NTZ, last_seen TIMESTAMP_NTZ"
    )


def history(spark, rows):
    return spark.createDataFrame(
        [(t, day(n), m, float(m)) for t, n, m in rows],
        "trend_term STRING, run_date DATE, mention_count INT, engagement_score DOUBLE",
    )


def lines(spark, terms, rows, **kw):
    result = timeline.timelines(today(spark, *terms), history(spark, rows), AS_OF, **kw)
    return {r.term: r for r in result.collect()}


def test_new_streak_and_recurring(spark):
    rows = [("silver", n, 4) for n in (1, 2, 3)] + [("eggs", 30, 7), ("chips", 1, 30), ("chips", 3, 30)]
    got = lines(spark, ["$NEW", "Silver", "#Eggs", "chips"], rows)
    assert (got["$NEW"].is_new, got["$NEW"].badge, got["$NEW"].consecutive_days) == (True, "New", 0)
    assert got["$NEW"].trajectory == "emerging"
    assert (got["Silver"].consecutive_days, got["Silver"].total_appearances) == (4, 4)
    assert (got["Silver"].badge, got["Silver"].trajectory) == ("Day 4", "accelerating")
    assert (got["#Eggs"].is_recurring, got["#Eggs"].days_since_last) == (True, 30)
    assert got["#Eggs"].badge == "Last seen 30d ago"
    assert (got["chips"].badge, got["chips"].trajectory) == ("Day 2", "declining")


def test_marks_do_not_hide_history(spark):
    got = lines(spark, ["$NVDA"], [("nvda", 1, 2)])
    assert not got["$NVDA"].is_new


def test_rows_of_today_and_after_are_not_history(spark):
    got = lines(spark, ["silver"], [("silver", 0, 9), ("silver", -1, 9), ("silver", 1, 2), ("silver", 2, 2)])
    assert (got["silver"].consecutive_days, got["silver"].total_appearances) == (3, 3)


def test_lookback_and_thresholds_are_parameters(spark):
    rows = [("a", 181, 1), ("b", 10, 1)]
    got = lines(spark, ["a", "b"], rows, gap_threshold=7)
    assert got["a"].is_new
    assert got["b"].is_recurring
    assert not lines(spark, ["b"], rows)["b"].is_recurring
    assert lines(spark, ["b"], [("b", 1, 1)], consecutive_threshold=2)["b"].badge == "Day 2"


def test_streak_equals_loop(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for i in range(60):
        days = sorted(rng.sample(range(1, 20), rng.randint(0, 15)))
        rows += [(f"t{i}", n, rng.randint(1, 9)) for n in days]
        streak = 0
        while streak + 1 in days:
            streak += 1
        expected[f"t{i}"] = (streak + 1 if days else 0, len(days) + 1, min(days) if days else None)
    got = lines(spark, list(expected), rows)
    assert {
        t: (r.consecutive_days, r.total_appearances, r.days_since_last) for t, r in got.items()
    } == expected
    assert all(len(r.previous_mentions) <= 7 for r in got.values())


def test_class_counts_and_order(spark):
    rows = [("a", 1, 1), ("b", 1, 1), ("b", 2, 1), ("c", 20, 1), ("d", 40, 1), ("e", 5, 1)]
    result = timeline.timelines(today(spark, "a", "b", "c", "d", "e", "new"), history(spark, rows), AS_OF)
    assert timeline.class_counts(result).first().asDict() == {
        "new_trends": 1, "continuing_trends": 2, "recurring_trends": 2, "temporal_patterns": 5,
    }
    assert [r.term for r in timeline.context_order(result).collect()] == ["b", "a", "d", "c"]


def test_run_details_count_retweets_but_not_their_engagement(spark):
    at = dt.datetime(2024, 6, 30, 8)
    posts = spark.createDataFrame(
        [("x", 10, 0, 0, False, at), ("x", 99, 0, 0, True, at + dt.timedelta(hours=1))],
        "trend STRING, likes INT, retweets INT, replies INT, is_retweet BOOLEAN, created_at TIMESTAMP_NTZ",
    )
    row = timeline.run_details(posts).first()
    assert (row.mentions, row.engagement, row.last_seen) == (2, 10.0, at + dt.timedelta(hours=1))
    assert timeline.top_engagement(posts).first()[0] == 99.0
    assert timeline.top_engagement(posts.limit(0)).first()[0] == 0.0


def test_streaks_and_gaps(spark):
    h = history(spark, [("a", n, 2) for n in (10, 9, 8, 5, 4)])
    got = sorted((r.n_days, r.first_day) for r in timeline.streaks(h).collect())
    assert got == [(2, day(5)), (3, day(10))]
    gaps = timeline.appearance_gaps(h).orderBy("run_date").collect()
    assert [r.gap_days for r in gaps] == [None, 1, 1, 3, 1]
    assert [r.recent_mean for r in gaps] == [None, 2.0, 2.0, 2.0, 2.0]


def test_history_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "h")
    history(spark, [("a", n, 1) for n in range(5)]).write.partitionBy("run_date").parquet(path)
    plan = timeline.history_window(spark.read.parquet(path), AS_OF, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(run_date" in plan


def test_two_spellings_on_one_day_are_one_appearance(spark):
    rows = [("$nvda", 1, 2), ("nvda", 1, 3), ("NVDA", 2, 4), ("#nvda", 3, 5)]
    got = lines(spark, ["$NVDA"], rows)["$NVDA"]
    assert (got.consecutive_days, got.total_appearances, got.previous_mentions) == (4, 4, [5, 4, 5])
    past = timeline.past_profile(timeline.history_window(history(spark, rows), AS_OF), AS_OF).first()
    assert (past.streak, past.past_appearances) == (3, 3)
    h = history(spark, rows)
    assert [(r.trend_term, r.n_days, r.mentions) for r in timeline.streaks(h).collect()] == [("nvda", 3, 14)]
    assert [r.gap_days for r in timeline.appearance_gaps(h).orderBy("run_date").collect()] == [None, 1, 1]


def test_windows_end_at_the_as_of_day(spark):
    h = history(spark, [("$NVDA", n, n + 10) for n in (40, 8, 7, 1, 0, -1, -30)])
    assert [r.mention_count for r in timeline.trend_history(h, "$NVDA", AS_OF, days=7).collect()] == [10, 11, 17]
    assert timeline.trend_history(h, "nvda", AS_OF, days=7).count() == 3
    recent = timeline.recent_trends(h, AS_OF, days=7).first()
    assert [d.mention_count for d in recent.days] == [10, 11, 17]
