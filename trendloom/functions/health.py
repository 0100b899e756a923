"""Expressions over run metrics: duration, errors, warnings and alerts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STORE_FAILURE = "Failed to store memory"


def duration_seconds(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / 1e6


def duration_label(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.format_string("%.1fs", seconds))
        .when(seconds < 3600, F.format_string("%.1fm", seconds / 60))
        .otherwise(F.format_string("%.1fh", seconds / 3600))
    )


def has_critical_errors(
    posts: Column, sources_active: Column, sources_total: Column, errors: Column, sent: Column
) -> Column:
    return (
        (posts == 0)
        | ((sources_active == 0) & (sources_total > 0))
        | ((F.size(errors) > 0) & ~sent)
    )


def has_warnings(
    posts: Column, trends: Column, sources_active: Column, sources_total: Column, warnings: Column
) -> Column:
    return (
        (posts < 100)
        | (trends == 0)
        | (sources_active < sources_total * 0.5)
        | (F.size(warnings) > 0)
    )


def alert(
    posts: Column,
    trends: Column,
    sources_active: Column,
    sources_total: Column,
    errors: Column,
    warnings: Column,
    sent: Column,
) -> Column:
    """(alert, severity, reason) of a run: the first rule that applies."""
    critical = has_critical_errors(posts, sources_active, sources_total, errors, sent)
    n_errors = F.size(errors)
    failures = F.size(F.filter(warnings, lambda w: F.contains(w, F.lit(STORE_FAILURE))))

    def raised(severity: str, *reason: Column | str) -> Column:
        parts = [F.lit(r) if isinstance(r, str) else r.cast("string") for r in reason]
        return F.struct(
            F.lit(True).alias("alert"),
            F.lit(severity).alias("severity"),
            F.concat(*parts).alias("reason"),
        )

    quiet = F.struct(
        F.lit(False).alias("alert"),
        F.lit("ok").alias("severity"),
        F.lit("All systems operational").alias("reason"),
    )
    return (
        F.when(critical & (posts == 0), raised("critical", "Zero posts collected"))
        .when(critical & (sources_active == 0), raised("critical", "All sources unavailable"))
        .when(critical & (n_errors > 0), raised("critical", n_errors, " error(s) occurred"))
        .when(failures > 0, raised("warning", "Memory storage failed - ", failures, " failure(s)"))
        .when(posts < 50, raised("warning", "Very low post count (", posts, ")"))
        .when(trends == 0, raised("warning", "No trends discovered"))
        .when(
            sources_active < sources_total * 0.3,
            raised("warning", "Only ", sources_active, "/", sources_total, " sources active"),
        )
        .otherwise(quiet)
    )
