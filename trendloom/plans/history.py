"""Queries over trend history: timelines, streaks, gaps, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.functions import scoring
from trendloom.operators import timeline
from trendloom.plans import oracle as o
from trendloom.plans import testdata as td
from trendloom.plans.registry import query
from trendloom.session import work_folder
from trendloom.sources import tables

AS_OF = "DATE '2024-01-20'"


def today_details(spark, sf):
    """Figures of the trends active on the as-of day."""
    events = td.table(spark, sf, "events").where(F.to_date("ts") == F.lit(td.AS_OF))
    return events.groupBy(
        F.concat("event_type", F.lit("_"), F.col("user_id").cast("string")).alias("trend")
    ).agg(
        F.count(F.lit(1)).cast("int").alias("mentions"),
        (F.sum(F.round(F.col("value") * 100).cast("bigint")) / 100.0).alias("engagement"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def today_timelines(spark, sf):
    history = td.derived(spark, sf, "trend_history")
    return timeline.timelines(today_details(spark, sf), history, td.AS_OF)


_TODAY = """SELECT concat(event_type, '_', CAST(user_id AS VARCHAR)) AS term, CAST(count(*) AS INT) AS mentions_today,
    sum(CAST(round(value * 100) AS BIGINT)) / 1e2 AS engagement_today, min(ts) AS first_seen_today,
    max(ts) AS last_seen_today
  FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-20' GROUP BY 1"""
# The streak: days before today without a missing day, found by walking back from yesterday.
_TIMELINES = f"""SELECT t.*, coalesce(p.streak + 1, 0) AS consecutive_days, coalesce(p.n, 0) + 1 AS total_appearances,
    p.last_seen_date, CAST({AS_OF} - p.last_seen_date AS INT) AS days_since_last,
    coalesce(p.mentions, '') AS previous_mentions, p.recent_mean
  FROM today t LEFT JOIN (
    SELECT lower(trend_term) AS term, CAST(count(*) AS INT) AS n, max(run_date) AS last_seen_date,
      CAST(count(*) FILTER (run_date = {AS_OF} - CAST(rn AS INT)) AS INT) AS streak,
      string_agg(CAST(mention_count AS VARCHAR), ',' ORDER BY run_date DESC) FILTER (rn <= 7) AS mentions,
      avg(mention_count) FILTER (rn <= 3) AS recent_mean
    FROM (SELECT *, row_number() OVER (PARTITION BY trend_term ORDER BY run_date DESC) AS rn FROM trend_history
          WHERE run_date >= {AS_OF} - 180 AND run_date < {AS_OF}) h GROUP BY 1) p ON lower(t.term) = p.term"""
_LABELLED = """SELECT *, total_appearances = 1 AS is_new, consecutive_days >= 2 AS is_continuing,
    total_appearances <> 1 AND coalesce(days_since_last >= 14, false) AS is_recurring,
    CASE WHEN total_appearances = 1 THEN 'New' WHEN consecutive_days >= 3 THEN 'Day ' || consecutive_days
         WHEN days_since_last >= 180 THEN 'Last seen ' || days_since_last // 30 || 'mo ago'
         WHEN days_since_last >= 14 THEN 'Last seen ' || days_since_last || 'd ago'
         WHEN consecutive_days = 2 THEN 'Day 2' ELSE '' END AS badge,
    CASE WHEN recent_mean IS NULL THEN 'emerging' WHEN mentions_today > recent_mean * 1.5 THEN 'accelerating'
         WHEN mentions_today < recent_mean * 0.5 THEN 'declining' ELSE 'stable' END AS trajectory
  FROM timelines"""
LABELLED = {"today": _TODAY, "timelines": _TIMELINES, "labelled": _LABELLED}


@query(
    "trend_timelines",
    o.with_ctes(
        ["trend_history"],
        """SELECT term, first_seen_today, last_seen_today, mentions_today, engagement_today, consecutive_days,
             total_appearances, last_seen_date, days_since_last, previous_mentions, is_new, is_continuing,
             is_recurring, badge, trajectory FROM labelled""",
        **LABELLED,
    ),
)
def _(spark, sf):
    rows = today_timelines(spark, sf)
    counts = F.array_join(F.col("previous_mentions").cast("array<string>"), ",")
    return rows.withColumn("previous_mentions", counts).drop("term_normalized", "previous_engagements")


@query(
    "single_timeline",
    o.with_ctes(
        ["trend_history"],
        "SELECT term, consecutive_days, total_appearances, badge FROM labelled WHERE lower(term) = 'view_28'",
        **LABELLED,
    ),
)
def _(spark, sf):
    rows = timeline.timeline_of(today_timelines(spark, sf), "View_28")
    return rows.select("term", "consecutive_days", "total_appearances", "badge")


@query(
    "temporal_class_counts",
    o.with_ctes(
        ["trend_history"],
        """SELECT count(*) FILTER (is_new) AS new_trends, count(*) FILTER (NOT is_new AND is_continuing) AS continuing_trends,
             count(*) FILTER (NOT is_new AND NOT is_continuing AND is_recurring) AS recurring_trends,
             count(*) FILTER (is_new OR is_continuing OR is_recurring) AS temporal_patterns FROM labelled""",
        **LABELLED,
    ),
)
def _(spark, sf):
    return timeline.class_counts(today_timelines(spark, sf))


@query(
    "temporal_context_order",
    o.with_ctes(
        ["trend_history"],
        """SELECT term, 'continuing' AS temporal_class, 0 AS class_order, consecutive_days AS weight FROM labelled WHERE is_continuing
           UNION ALL SELECT term, 'recurring', 1, days_since_last FROM labelled WHERE is_recurring""",
        **LABELLED,
    ),
)
def _(spark, sf):
    return timeline.context_order(today_timelines(spark, sf))


@query(
    "trend_streaks",
    o.with_ctes(
        ["trend_history"],
        """SELECT trend_term, min(run_date) AS first_day, max(run_date) AS last_day, count(*) AS n_days,
             CAST(sum(mention_count) AS BIGINT) AS mentions
           FROM (SELECT *, sum(CAST(gap AS INT)) OVER (PARTITION BY trend_term ORDER BY run_date) AS island FROM (
                   SELECT *, coalesce(run_date - lag(run_date) OVER (PARTITION BY trend_term ORDER BY run_date) > 1, true) AS gap
                   FROM trend_history) g) i GROUP BY trend_term, island""",
    ),
)
def _(spark, sf):
    return timeline.streaks(td.derived(spark, sf, "trend_history"))


@query(
    "appearance_gaps",
    o.with_ctes(
        ["trend_history"],
        """SELECT trend_term, run_date, CAST(mention_count AS BIGINT) AS mention_count,
             CAST(run_date - lag(run_date) OVER w AS INT) AS gap_days, CAST(row_number() OVER w AS INT) AS appearances,
             avg(mention_count) OVER (PARTITION BY trend_term ORDER BY run_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS recent_mean
           FROM trend_history WINDOW w AS (PARTITION BY trend_term ORDER BY run_date)""",
    ),
)
def _(spark, sf):
    return timeline.appearance_gaps(td.derived(spark, sf, "trend_history"))


@query(
    "history_trajectories",
    o.with_ctes(
        ["trend_history"],
        """SELECT trend_term, run_date, CASE WHEN m IS NULL THEN 'emerging' WHEN mention_count > m * 1.5 THEN 'accelerating'
             WHEN mention_count < m * 0.5 THEN 'declining' ELSE 'stable' END AS trajectory
           FROM (SELECT *, avg(mention_count) OVER (PARTITION BY trend_term ORDER BY run_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m
                 FROM trend_history) h""",
    ),
)
def _(spark, sf):
    gaps = timeline.appearance_gaps(td.derived(spark, sf, "trend_history"))
    label = scoring.trajectory(F.col("mention_count"), F.col("recent_mean"))
    return gaps.select("trend_term", "run_date", label.alias("trajectory"))


@query(
    "single_trend_history",
    o.with_ctes(
        ["trend_history"],
        f"""SELECT run_date, CAST(mention_count AS BIGINT) AS mention_count, engagement_score FROM trend_history
            WHERE trend_term = 'click_12' AND run_date BETWEEN {AS_OF} - 30 AND {AS_OF}""",
    ),
)
def _(spark, sf):
    return timeline.trend_history(td.derived(spark, sf, "trend_history"), "$Click_12", td.AS_OF)


@query(
    "recent_trends",
    o.with_ctes(
        ["trend_history"],
        f"""SELECT trend_term, string_agg(CAST(run_date AS VARCHAR) || ':' || mention_count, ',' ORDER BY run_date DESC) AS days,
              round(sum(engagement_score), 4) AS engagement
            FROM trend_history WHERE run_date BETWEEN {AS_OF} - 7 AND {AS_OF} GROUP BY 1""",
    ),
)
def _(spark, sf):
    recent = timeline.recent_trends(td.derived(spark, sf, "trend_history"), td.AS_OF)
    day = F.transform(
        "days",
        lambda d: F.concat(d["run_date"].cast("string"), F.lit(":"), d["mention_count"].cast("string")),
    )
    cents = F.aggregate(
        F.transform("days", lambda d: F.round(d["engagement_score"] * 100).cast("bigint")),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    return recent.select(
        "trend_term", F.array_join(day, ",").alias("days"), (cents / 100.0).alias("engagement")
    )


@query(
    "trend_history_upserted",
    o.with_ctes(
        ["trend_history"],
        f"""SELECT trend_term, run_date, CASE WHEN run_date >= {AS_OF} THEN mention_count * 2 ELSE mention_count END AS mention_count,
              engagement_score FROM trend_history""",
    ),
)
def _(spark, sf):
    """Store the history, then correct its last days by a second write."""
    history = td.derived(spark, sf, "trend_history")
    path = work_folder(spark, "trend-history")
    tables.store_trend_history(history, path)
    corrected = history.where(F.col("run_date") >= F.lit(td.AS_OF)).withColumn(
        "mention_count", F.col("mention_count") * 2
    )
    tables.store_trend_history(corrected, path)
    return tables.read_trend_history(spark, path)


@query(
    "digest_badges",
    o.with_ctes(
        ["digests", "trend_history"],
        """SELECT run_date, string_agg(CASE WHEN coalesce(badge, '') = '' THEN l.term ELSE l.term || ' [' || badge || ']' END,
             ', ' ORDER BY pos) AS trend_labels
           FROM listed l LEFT JOIN labelled b ON b.term = l.term GROUP BY 1""",
        **LABELLED,
        listed="""SELECT DATE '2024-01-20' - CAST(user_id AS INT) AS run_date, CAST(i AS INT) AS pos,
            concat(['click', 'view', 'error'][i], '_', CAST(user_id AS VARCHAR)) AS term
          FROM (SELECT DISTINCT user_id FROM events) u, range(1, 4) r(i)""",
    ),
)
def _(spark, sf):
    # One digest per user of the events table, naming three of its terms.
    users = td.table(spark, sf, "events").select("user_id").distinct()
    names = [F.concat(F.lit(f"{k}_"), F.col("user_id").cast("string")) for k in ("click", "view", "error")]
    digests = users.select(
        F.date_sub(F.lit(td.AS_OF), F.col("user_id").cast("int")).alias("run_date"),
        F.array(*names).alias("trends"),
    )
    badges = timeline.digest_badges(digests, today_timelines(spark, sf))
    return badges.withColumn("trend_labels", F.array_join("trend_labels", ", "))


