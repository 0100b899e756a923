from __future__ import annotations

import datetime as dt
import json

from trendloom import __main__ as cli
from trendloom.plans import daily
from trendloom.sources import tables
from trendloom.session import work_folder


def deliver(folder, day, n=12):
    folder.mkdir()
    rows = [
        {
            "id": i, "rawContent": f"nvidia $NVDA up 12% on chip supply, copper shortage {i}", "lang": "en",
            "user": {"username": f"u{i}", "displayname": "U"}, "hashtags": ["gpu"], "likeCount": 5000,
            "date": dt.datetime(2024, 1, day, 8, i).isoformat(),
        }
        for i in range(n)
    ]
    (folder / "posts.json").write_text("\n".join(json.dumps(r) for r in rows))
    return str(folder)


def test_two_days(spark, tmp_path, capsys):
    start = dt.date(2023, 12, 20)
    bars = [(s, start + dt.timedelta(days=i), 100.0 + i % 7, 1000) for i in range(20) for s in ("NVDA", "SPY", "HG=F")]
    spark.createDataFrame(bars, "symbol STRING, date DATE, close DOUBLE, volume BIGINT").write.parquet(str(tmp_path / "bars"))
    news = [("economy", 0, i, None, "b", f"u{i}", "s", "d") for i in range(7)]
    spark.createDataFrame(
        news, "query STRING, ord INT, rnk LONG, title STRING, body STRING, url STRING, source STRING, date STRING"
    ).write.parquet(str(tmp_path / "news"))
    digest = tmp_path / "digest.txt"
    digest.write_text("**Bottom Line:**\nBullish talk about chips and copper, shortage everywhere.")
    topics = tmp_path / "topics.txt"
    topics.write_text("copper shortage OR chip supply\nunheard of\n")
    store = work_folder(spark, "store")
    for day in (3, 4):
        cli.main([
            "run", "--posts", deliver(tmp_path / f"p{day}", day), "--bars", str(tmp_path / "bars"),
            "--news", str(tmp_path / "news"), "--store", store, "--as-of", f"2024-01-0{day}", "--digest", str(digest),
            "--topics", str(topics), "--posts-per-topic", "11",
        ])
    shown = capsys.readouterr().out
    assert "New" in shown and "Day 2" in shown
    stored = tables.read_digests(spark, f"{store}/digests").collect()
    assert {(d.run_date.day, d.signal_strength, d.tweet_count > 0) for d in stored} == {(3, "medium", True), (4, "medium", True)}
    history = daily.stored_history(spark, store)
    assert history.where("trend_term = 'nvda'").count() == 2
    log = daily.stored(spark, f"{store}/ingest_log", daily.schemas.INGEST_LOG)
    assert sorted((r.run_date.day, r.topic[:6], r.attempt, r.n_posts) for r in log.collect()) == [
        (day, topic, 1, n) for day in (3, 4) for topic, n in (("copper", 11), ("unhear", 0))
    ]
    metrics = daily.stored(spark, f"{store}/run_metrics", daily.schemas.RUN_METRICS)
    assert [(r.broad_posts, r.sources_active, r.sources_total) for r in metrics.collect()] == [(11, 1, 2)] * 2
    assert {r.severity for r in daily.health.run_health(metrics).collect()} <= {"ok", "warning"}
    assert [r.news_count for r in spark.read.parquet(f"{store}/summaries").collect()] == [5, 5]
    similar = daily.parallels(spark, store, dt.date(2024, 1, 4), min_similarity=-0.5).collect()
    assert [(r.query_id, r.id) for r in similar] == [("memory_20240104", "memory_20240103")]
    assert daily.parallels(spark, store, dt.date(2024, 1, 3), min_similarity=-0.5).count() == 0
    cli.main(["parallels", "--store", store, "--as-of", "2024-01-04", "--min-similarity", "-0.5"])
    assert "memory_20240103" in capsys.readouterr().out


def test_run_day_claims_quotes_and_keep_list(spark, tmp_path):
    from trendloom.sources.posts import read_raw_posts

    posts = read_raw_posts(spark, deliver(tmp_path / "p", 3))
    start = dt.date(2023, 12, 20)
    bars = spark.createDataFrame(
        [("NVDA", start + dt.timedelta(days=i), 100.0 + i, 1000) for i in range(15)],
        "symbol STRING, date DATE, close DOUBLE, volume BIGINT",
    )
    news = spark.createDataFrame(
        [("q", 0, 0, "t", "b", "u", "s", "d")],
        "query STRING, ord INT, rnk LONG, title STRING, body STRING, url STRING, source STRING, date STRING",
    )
    keep = spark.createDataFrame([("$nvda",), ("unknown",)], "term STRING")
    history = daily.stored_history(spark, str(tmp_path / "none"))
    run = daily.run_day(posts, history, bars, news, dt.date(2024, 1, 3), keep)
    assert [r.term for r in run.timelines.collect()] == ["$nvda"]
    assert run.rejected.count() == 9
    assert run.trend_posts.count() == 12
    assert {r.verdict for r in run.claims.collect()} == {"EXAGGERATED"}
    assert run.claims.count() == 12
    assert [r.symbol for r in run.quotes.collect()] == ["NVDA"]
    row = run.summary.first()
    assert (row.trends, row.tweet_count, row.news_count, row.top_engagement) == (["$nvda"], 12, 1, 5000.0)
    assert all(len(r.sample_tweets) == 3 for r in run.candidates.collect())


def test_complete_topics_are_not_collected_again(spark, tmp_path):
    from trendloom.sources.posts import read_raw_posts

    posts, day = read_raw_posts(spark, deliver(tmp_path / "p", 3)), dt.date(2024, 1, 3)
    topics = spark.createDataFrame([("copper",), ("chip",), ("gold",)], "topic STRING")
    log = spark.createDataFrame([(day, "copper", 1, 5), (day, "gold", 1, 0)], daily.schemas.INGEST_LOG)
    taken, attempts = daily.collect_topics(posts, topics, log, day, limit_per_topic=4)
    assert sorted((r.topic, r.attempt, r.n_posts) for r in attempts.collect()) == [("chip", 2, 4), ("gold", 2, 0)]
    assert {r.topic for r in taken.collect()} == {"chip"} and taken.count() == 4
    assert daily.collect_topics(posts, topics, log, day, language="de")[0].count() == 0
