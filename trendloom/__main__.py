"""Command line: ``python -m trendloom run ...`` or ``spark-submit`` of the same module.

run     one daily run over post, bar and news tables; stores summary, digest, history, memory,
        the ingest log and the run's metrics, and shows its health
parallels  past days most similar to the conditions of a stored day
ingest  process newly arrived raw post files into the daily activity table
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import functions as F

from trendloom import schemas, session
from trendloom.functions.text import TermRules, load_terms
from trendloom.operators import health
from trendloom.operators.ranking import TrendLimits, dedupe_posts
from trendloom.plans import daily
from trendloom.sources.posts import read_raw_posts
from trendloom.streaming import posts_stream


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="trendloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run")
    run.add_argument("--posts", required=True, help="raw posts")
    run.add_argument("--format", default="json", choices=("json", "parquet", "orc"))
    run.add_argument("--bars", required=True, help="Parquet: symbol, date, close, volume")
    run.add_argument("--news", required=True, help="Parquet: query, ord, rnk, title, body, url, source, date")
    run.add_argument("--store", required=True, help="folder of all stored tables")
    run.add_argument("--as-of", type=dt.date.fromisoformat, required=True)
    run.add_argument("--digest", default="", help="text file with the digest of the day")
    run.add_argument("--topics", help="text file of topics to collect, one 'a OR b' per line; without it all posts count")
    run.add_argument("--posts-per-topic", type=int, default=200)
    run.add_argument("--language", default="en")
    run.add_argument("--noise", help="noise word list, one per line, instead of the default")
    run.add_argument("--keep", help="text file with the terms to keep, one per line")
    run.add_argument("--top-n", type=int, default=10)
    run.add_argument("--min-mentions", type=int, default=3)
    run.add_argument("--min-authors", type=int, default=2)
    past = commands.add_parser("parallels")
    past.add_argument("--store", required=True, help="folder of all stored tables")
    past.add_argument("--as-of", type=dt.date.fromisoformat, required=True)
    past.add_argument("--min-similarity", type=float, default=0.6)
    ingest = commands.add_parser("ingest")
    ingest.add_argument("--posts", required=True, help="folder in which raw post files arrive")
    ingest.add_argument("--format", default="json", choices=("json", "parquet", "orc"))
    ingest.add_argument("--table", required=True, help="folder of the activity table and its state")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = session.builder().getOrCreate()
    if args.command == "ingest":
        posts_stream.ingest_activity(posts_stream.read_raw_post_stream(spark, args.posts, args.format), args.table)
        posts_stream.ingested_activity(spark, args.table).orderBy("run_date", "trend_term").show()
        return
    if args.command == "parallels":
        daily.parallels(spark, args.store, args.as_of, min_similarity=args.min_similarity).show(10, False)
        return
    start = dt.datetime.now()
    posts = read_raw_posts(spark, args.posts, args.format)
    log = daily.stored(spark, f"{args.store}/ingest_log", schemas.INGEST_LOG)
    if args.topics:
        topics = spark.read.text(args.topics).where("value <> ''").withColumnRenamed("value", "topic")
        posts, attempts = daily.collect_topics(posts, topics, log, args.as_of, args.posts_per_topic, args.language)
    else:
        posts, attempts = dedupe_posts(posts.selectExpr("*", "'' AS topic")), log.limit(0)
    rules = TermRules(noise_terms=load_terms(spark, args.noise)) if args.noise else TermRules()
    keep = spark.read.text(args.keep).withColumnRenamed("value", "term") if args.keep else None
    run = daily.run_day(
        posts,
        daily.stored_history(spark, args.store),
        spark.read.parquet(args.bars),
        spark.read.schema(schemas.NEWS).parquet(args.news),
        args.as_of,
        keep,
        TrendLimits(args.top_n, args.min_mentions, args.min_authors),
        rules,
    )
    digest = "\n".join(r.value for r in spark.read.text(args.digest).collect()) if args.digest else ""
    now = dt.datetime.combine(args.as_of, dt.time(12))
    daily.store_day(run, args.store, args.as_of, digest, now)
    metrics = daily.run_metrics(run, posts, attempts, int(start.timestamp() * 1e6), start, dt.datetime.now())
    daily.store_log(session.written(metrics, "metrics"), attempts, args.store)
    all_runs = daily.stored(spark, f"{args.store}/run_metrics", schemas.RUN_METRICS)
    run.candidates.select("rank", "term", "mention_count", "unique_authors", "composite_score", "qualified").orderBy("rank").show(args.top_n, False)
    run.timelines.select("term", "badge", "trajectory", "mentions_today").orderBy("term").show(args.top_n, False)
    run.summary.show(1, False)
    health.run_health(all_runs).orderBy(F.desc("run_id")).show(1, False)


if __name__ == "__main__":
    main()
