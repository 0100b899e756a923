from __future__ import annotations

import datetime as dt
import json

import pytest
from trendloom.operators import mentions as m
from trendloom.session import work_folder
from trendloom.streaming import closed_windows as cw
from trendloom.streaming import posts_stream as ps

TAGS = (m.CASHTAG, m.HASHTAG)


def deliver(folder, name, *rows):
    """A file of raw posts: (id, day, hour, text, author)."""
    docs = [
        {"id": i, "rawContent": text, "user": {"username": author, "displayname": author}, "lang": "en",
         "date": dt.datetime(2024, 1, day, hour).isoformat(), "likeCount": 10, "hashtags": []}
        for i, day, hour, text, author in rows
    ]
    (folder / name).write_text("\n".join(json.dumps(d) for d in docs))


def test_ingest_resumes_and_counts_once(spark, tmp_path):
    folder = work_folder(spark, "ingest")
    deliver(tmp_path, "a.json", (1, 1, 8, "$NVDA", "u"), (2, 1, 9, "$NVDA $AMD", "v"))
    for _ in range(2):  # nothing new the second time
        ps.ingest_activity(ps.read_raw_post_stream(spark, str(tmp_path)), folder, TAGS)
    deliver(tmp_path, "b.json", (3, 1, 10, "$NVDA", "w"), (4, 2, 8, "$AMD", "u"))
    ps.ingest_activity(ps.read_raw_post_stream(spark, str(tmp_path)), folder, TAGS)
    got = {(r.trend_term, r.run_date.day): (r.mention_count, r.engagement_score) for r in ps.ingested_activity(spark, folder).collect()}
    assert got == {("nvda", 1): (3, 30.0), ("amd", 1): (1, 10.0), ("amd", 2): (1, 10.0)}


def test_stream_equals_batch_activity(spark, tmp_path):
    deliver(tmp_path, "a.json", *[(i, 1 + i % 5, i % 24, f"$T{'AB'[i % 2]}", f"u{i % 3}") for i in range(60)])
    folder = work_folder(spark, "ingest")
    ps.ingest_activity(ps.read_raw_post_stream(spark, str(tmp_path)), folder, TAGS)
    batch = m.daily_activity(m.mentions(ps.normalize_raw_posts(spark.read.schema(ps.schemas.RAW_POST).json(str(tmp_path))), TAGS))
    key = lambda r: (r.trend_term, r.run_date)
    assert sorted(map(tuple, ps.ingested_activity(spark, folder).collect())) == sorted(map(tuple, batch.collect()))
    assert len({key(r) for r in batch.collect()}) == 10


def test_many_batches_leave_few_parts(spark, tmp_path, monkeypatch):
    """Every file is a batch; a merge that stops before it deletes its parts changes no count."""
    monkeypatch.setattr(ps, "MAX_PARTS", 3)
    merge, calls = ps.merge_activity, []
    monkeypatch.setattr(ps, "merge_activity", lambda spark, folder, finished: calls.append(finished) or merge(spark, folder, finished, 3))
    folder = work_folder(spark, "parts")
    for n in range(14):
        deliver(tmp_path, f"{n:02}.json", (n, 1, n, "$NVDA", "u"))
    ps.ingest_activity(ps.read_raw_post_stream(spark, str(tmp_path), max_files=1), folder, TAGS)
    assert calls == list(range(-1, 13))
    parts = ps.numbered_folders(spark, f"{folder}/activity", "batch_id")
    assert len(parts) <= 4 and len(ps.numbered_folders(spark, f"{folder}/merged", "until")) == 1
    count = lambda: [tuple(r) for r in ps.ingested_activity(spark, folder).collect()]
    assert count() == [("nvda", dt.date(2024, 1, 1), 14, 140.0)]
    monkeypatch.setattr(ps, "delete_folder", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped here")))
    with pytest.raises(RuntimeError):
        merge(spark, folder, 13, 1)
    assert ps._merged_until(spark, folder) == 13
    assert count() == [("nvda", dt.date(2024, 1, 1), 14, 140.0)]
    monkeypatch.undo()
    merge(spark, folder, 13)
    assert ps.numbered_folders(spark, f"{folder}/activity", "batch_id") == []
    assert count() == [("nvda", dt.date(2024, 1, 1), 14, 140.0)]


def test_dedupe_across_files(spark, tmp_path):
    state = work_folder(spark, "dedupe")
    deliver(tmp_path, "a.json", (1, 1, 8, "x", "u"), (1, 1, 8, "x", "u"), (2, 1, 9, "y", "u"))
    first = ps.run_available(ps.deduplicated(ps.read_raw_post_stream(spark, str(tmp_path))), "d", state)
    assert sorted(r.id for r in first.collect()) == [1, 2]
    deliver(tmp_path, "b.json", (2, 1, 9, "y", "u"), (3, 1, 10, "z", "u"))
    both = ps.run_available(ps.deduplicated(ps.read_raw_post_stream(spark, str(tmp_path))), "d", state)
    assert sorted(r.id for r in both.collect()) == [1, 2, 3]


def test_late_posts_are_dropped_after_the_delay(spark, tmp_path):
    state, dropped = work_folder(spark, "daily"), []

    def counts():
        stream = ps.read_raw_post_stream(spark, str(tmp_path))
        rows = ps.daily_counts(stream, state, dt.timedelta(hours=12), TAGS)
        dropped.append(cw.late_posts(spark, state, stream).count())
        return {(r.run_date.day, r.key): (r.mention_count, r.unique_authors) for r in rows.collect()}

    deliver(tmp_path, "a.json", (1, 1, 8, "$NVDA", "u"), (2, 1, 9, "$NVDA", "v"), (3, 2, 8, "$NVDA", "u"))
    assert counts() == {}  # the first day may still get posts
    deliver(tmp_path, "b.json", (4, 1, 22, "$NVDA", "w"), (5, 2, 20, "$NVDA", "w"))
    assert counts() == {(1, "NVDA"): (3, 3)}
    deliver(tmp_path, "c.json", (6, 1, 23, "$NVDA", "x"), (7, 4, 20, "$NVDA", "w"))
    assert counts() == {(1, "NVDA"): (3, 3), (2, "NVDA"): (2, 2)}
    assert dropped == [0, 0, 1]


@pytest.mark.parametrize("step", ["stored", "counted", "entered"])
def test_a_batch_that_breaks_off_counts_once(spark, tmp_path, step):
    """The run stops after each step of its batch and is started again."""
    state, broken = work_folder(spark, "broken"), []

    def stop(at, batch):
        if at == step and not broken:
            broken.append(batch)
            raise RuntimeError("stopped here")

    deliver(tmp_path, "a.json", (1, 1, 8, "$NVDA", "u"), (2, 1, 9, "$NVDA", "v"), (3, 5, 8, "$AMD", "u"))
    stream = ps.read_raw_post_stream(spark, str(tmp_path))
    with pytest.raises(Exception):
        cw.run_closed(stream, state, cw.Windows(), TAGS, stop)
    assert broken
    for _ in range(2):
        rows = cw.run_closed(stream, state, cw.Windows(), TAGS)
        assert [(r.key, r.mention_count, r.unique_authors) for r in rows.collect()] == [("NVDA", 2, 2)]


def test_closed_days_leave_the_store(spark, tmp_path):
    state = work_folder(spark, "store")
    for day in range(1, 9):
        deliver(tmp_path, f"{day}.json", (day, day, 8, "$NVDA", f"u{day}"), (50 + day, day, 9, "$NVDA", "v"))
        rows = cw.run_closed(ps.read_raw_post_stream(spark, str(tmp_path)), state, cw.Windows(), TAGS)
    assert sorted((r.window_start.day, r.mention_count, r.unique_authors) for r in rows.collect()) == [(d, 2, 2) for d in range(1, 7)]
    kept = spark.read.parquet(f"{state}/arrivals")
    assert sorted({r.created_at.day for r in kept.collect()}) == [7, 8]
    assert len(cw._ledger(spark, state)) <= 2


def test_empty_stream(spark, tmp_path):
    deliver(tmp_path, "a.json")
    stream = ps.read_raw_post_stream(spark, str(tmp_path))
    assert ps.daily_counts(stream, work_folder(spark, "none"), term_types=TAGS).count() == 0


def test_sliding_windows(spark, tmp_path):
    deliver(tmp_path, "a.json", (1, 1, 8, "$NVDA", "u"), (2, 1, 9, "$NVDA", "v"), (3, 9, 8, "$AMD", "u"))
    stream = ps.read_raw_post_stream(spark, str(tmp_path))
    rows = ps.sliding_scores(stream, work_folder(spark, "s"), dt.timedelta(hours=1), term_types=TAGS).where("key = 'NVDA'").collect()
    assert len(rows) == 7
    full = [r for r in rows if r.mention_count == 2]
    assert len(full) == 5
    assert full[0].velocity_score == 20.0 * (1 + 2 * 2 / 2)


def test_command_line_ingest(spark, tmp_path, capsys):
    from trendloom import __main__ as cli

    deliver(tmp_path, "a.json", (1, 1, 8, "$NVDA copper", "u"), (2, 1, 9, "$NVDA", "v"))
    cli.main(["ingest", "--posts", str(tmp_path), "--table", work_folder(spark, "cli")])
    shown = capsys.readouterr().out
    assert "nvda" in shown and "copper" in shown
