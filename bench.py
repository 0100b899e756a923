"""Time the headline queries; prints one JSON line.

Every query runs twice: "cold" is the first run, "queries" and their total the second.
BENCH_SF_DIR names the base tables, BENCH_CPUS the cores, BENCH_QUERIES a comma-separated
choice of queries or "all".
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "top_candidates", "ngram_trends", "cashtag_trends", "top_terms_per_type", "candidate_samples",
    "topic_matches", "trend_posts", "daily_activity", "trend_timelines", "trend_streaks",
    "market_quotes", "bar_indicators", "claims_checked", "quotes_at_mention", "similar_memories",
    "memory_records", "run_health", "ingest_status", "economic_news", "trend_history_upserted",
    "stream_daily_counts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = os.environ.get("BENCH_QUERIES", "")

    from trendloom import session
    from trendloom.plans.catalog import QUERIES

    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = (
        session.builder("trendloom-bench")
        .master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "16g")
        .config(session.CHECKPOINT_DIR, tempfile.mkdtemp(prefix="trendloom-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor before the clock
    cold, seconds = {}, {}
    for name in names:
        for times in (cold, seconds):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {cold[name]} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries, second run",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "cold": cold,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
