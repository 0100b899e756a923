from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from trendloom.operators import phrases


def split(text):
    text = re.sub(r"(?<![a-z0-9_])'+|'+(?![a-z0-9_])", " ", text.lower())
    return re.sub(r"[^a-z0-9_$#'%&]+", " ", text).strip(" ").split(" ")


def plain(posts, listed):
    out = set()
    for i, text in posts:
        words = split(text) if text is not None else None
        for p in listed:
            wanted = p.split(" ") if p is not None else None
            if words and wanted and any(words[k : k + len(wanted)] == wanted for k in range(len(words))):
                out.add((i, p))
    return out


def hits(spark, posts, listed):
    df = spark.createDataFrame(posts, "id LONG, text STRING")
    rows = phrases.phrase_hits(df, spark.createDataFrame([(p,) for p in listed], "phrase STRING")).collect()
    got = [(r.id, r.phrase) for r in rows]
    assert len(got) == len(set(got))
    return set(got)


def test_like_a_plain_search(spark):
    rng = random.Random(7)
    common = ["a", "b", "the", "market"]
    pool = common * 5 + [f"w{k}" for k in range(30)] + ["it's", "$nv", "#x", "'q'", "c-d"]
    posts = [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))) for k in range(400)]
    posts += [(1000, None), (1001, ""), (1002, "!!"), (1003, "a a a a"), (1004, "a b a b a")]
    listed = {" ".join(rng.choice(pool[:40]) for _ in range(rng.choice((1, 1, 2, 2, 3, 6)))) for _ in range(500)}
    listed |= {"a a", "a b a", "b a b a", "a", "", "nowhere", "a nowhere", "market " * 30 + "a"}
    listed = sorted(listed) + [None]
    assert hits(spark, posts, listed) == plain(posts, listed)
    words = sorted({p for p in listed if p and " " not in p})
    assert hits(spark, posts, words) == plain(posts, words)


def test_empty_tables_and_repeated_rows(spark):
    assert hits(spark, [], ["a"]) == set()
    assert hits(spark, [(1, "a b")], []) == set()
    assert hits(spark, [(1, "a b"), (1, "a b"), (2, "a b")], ["a b"]) == {(1, "a b"), (2, "a b")}


def test_the_rarest_word_is_the_anchor(spark):
    words = spark.createDataFrame([(["the", "market", "fell"],), (["the", "market"],), (["the"],)], "_words ARRAY<STRING>")
    listed = spark.createDataFrame([("the market fell",), ("the market",), ("the moon",), ("the",)], "phrase STRING")
    got = {tuple(r) for r in phrases.anchors(words, listed).collect()}
    assert got == {("the market fell", "fell", 2, 0), ("the market", "market", 1, 0), ("the", "the", 0, 0)}


def test_many_phrases_are_joined_by_word(spark):
    posts = spark.range(2000).select("id", F.concat_ws(" ", F.lit("the market"), F.concat(F.lit("n"), "id"), F.lit("rose")).alias("text"))
    listed = spark.range(100_000).select(F.concat(F.lit("market n"), F.col("id").cast("string"), F.lit(" rose")).alias("phrase"))
    found = phrases.phrase_hits(posts, listed)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == 2000
