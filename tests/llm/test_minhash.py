from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.compare import compare, connect
from tests.conftest import SF_SMALL
from tests.llm.data import ROWS, documents, empty

from trendloom.llm import graph, minhash, queries


def shingles(text, n):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not found:
        return set()
    return {tuple(found[i : i + n]) for i in range(len(found) - n + 1)} or {tuple(found)}


def brute(rows, n, percent=80):
    sets = [shingles(r[1], n) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), 1 << 60), r[0])
    out = [(r[0], len(sets[i]), least.get(root(i)), r[0] is None or least[root(i)] == r[0]) for i, r in enumerate(rows)]
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["Ünder", "A", "b,"]
    rows = []
    for group in range(25):
        text = [rng.choice(words) for _ in range(rng.choice([1, 2, 4, 9, 30, 80]))]
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) + 100, "  ".join(copy), "en", "a", 0))
    chain = [f"c{i}" for i in range(100)]
    for step in range(12):  # neighbours are similar, the ends are not
        rows.append((1000 - step, " ".join(chain[step * 4 : step * 4 + 60]), "en", "a", 0))
    return rows + ROWS


@pytest.mark.parametrize("n", [1, 2, 5])
def test_components(spark, n):
    rows = corpus()
    got = minhash.near_documents(documents(spark, rows), minhash.Rule(words=n))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, n)


def test_no_documents(spark):
    assert minhash.near_documents(empty(spark)).count() == 0
    blank = documents(spark, [(1, None, None, None, None), (2, " ", None, None, None)])
    assert sorted(tuple(r) for r in minhash.near_documents(blank).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_first_of_each(spark):
    rows = corpus()
    docs = documents(spark, rows)
    out = minhash.first_of_each(docs)
    assert out.schema == docs.schema
    want = sorted((r[0] for r in brute(rows, 2) if r[3]), key=repr)
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == want


def test_one_id_on_a_copied_and_on_a_unique_text(spark):
    base = " ".join(f"k{i}" for i in range(40))
    near = base.replace("k39", "other")
    alone = " ".join(f"u{i}" for i in range(30))
    given = [(1, base), (9, base), (9, alone), (5, "five words and a few"), (5, "five words and a few"), (5, "Five  words and a few")]
    given += [(None, near), (None, "no id here at all"), (None, "no id here at all"), (None, "another without"), (4, ""), (4, ""), (None, None)]
    given += [(7, alone.replace("u", "z")), (7, alone.replace("u", "z") + " end")]
    docs = documents(spark, [(i, text, "en", "a", 0) for i, text in given])

    def left(**how):
        out = minhash.first_of_each(docs, **how)
        assert out.schema == docs.schema
        return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)

    assert left() == sorted([x for k, x in enumerate(given) if k != 1], key=repr)
    once = left(repeats=False)
    sevens = [x for x in once if x[0] == 7]
    assert len(sevens) == 1 and sevens[0] in given
    want = [(1, base), (9, alone), (5, "Five  words and a few"), (None, "no id here at all"), (None, "another without"), (4, ""), (4, ""), (None, None)]
    assert once == sorted(want + sevens, key=repr)


def test_chains_and_stars_of_links(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(200, 260)] + [(5, i) for i in range(300, 420)] + [(7, 7)]
    links += [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(120)]
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_query(spark):
    name = "op7_coordinate_near_duplicates"
    assert compare(queries.QUERIES[name](spark, SF_SMALL), connect(SF_SMALL), queries.ORACLES[name]) is None


@pytest.mark.parametrize("percent", [100, 80, 50])
def test_similar_sizes_lie_in_neighbouring_bands(spark, percent):
    rule = minhash.Rule(percent=percent)
    sizes = [(n, -(-n * percent // 100)) for n in [*range(1, 3000), *range(10**6, 10**6 + 500)]]
    bands = [minhash._band(F.col(c), rule).alias(c) for c in ("large", "small")]
    rows = spark.createDataFrame(sizes, "large long, small long").select(*bands).collect()
    assert all(0 <= r["large"] - r["small"] <= 1 for r in rows)


def test_sets_of_several_homes_meet_in_a_cell(spark):
    # key, rep, home, class, n: two that may be similar, one that is too large, one of the class of the first
    own = [(1, 10, 10, 10, 100), (1, 11, 11, 11, 81), (1, 12, 12, 12, 400), (2, 10, 10, 10, 100), (2, 13, 10, 10, 100)]
    own = spark.createDataFrame(own, "key long, rep long, home long, class long, n long")
    met = minhash._between_classes(own, minhash.Rule())
    assert {(r["key"], r["rep"]) for r in met.collect()} == {(1, 10), (1, 11)}
    assert minhash._meeting_often(met, minhash.Rule(meetings=2)).count() == 0
    assert minhash._meeting_often(met, minhash.Rule(meetings=1)).count() == met.count()


def test_postings_between_classes_are_found_once(spark, monkeypatch):
    plans = []
    often = minhash._meeting_often
    monkeypatch.setattr(minhash, "_meeting_often", lambda own, rule: plans.append(own._jdf.queryExecution().optimizedPlan().toString()) or often(own, rule))
    docs = spark.createDataFrame([(i, f"a b c d e f g h i j k l m n o p q r s t u v w x y z {i}") for i in range(20)], "doc_id long, text string")
    assert minhash.near_documents(docs).where("kept").count() == 1
    assert len(plans) == 1 and "Join" not in plans[0]


def test_sets_that_meet_others_in_single_coordinates_only_are_left_out(spark):
    """Every value of theirs is met by some other set, as in large tables, but no other set has two at once."""
    rng = np.random.default_rng(3)
    rule = minhash.Rule()
    unlike = rng.integers(0, 4, (400, rule.coordinates)).astype(np.uint64)
    unlike = unlike * np.uint64(1000) + rng.integers(0, 60, unlike.shape).astype(np.uint64)  # one of 240 values
    like = rng.integers(0, 2**40, (1, rule.coordinates)).astype(np.uint64).repeat(2, axis=0)
    like[1, rng.permutation(rule.coordinates)[rule.matches :]] += np.uint64(1)  # as few agree as the rule allows
    rows = np.concatenate([unlike, like])
    sets = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(minhash._packed(rows))], "rep long, sig binary")
    assert minhash._prefixes(sets, rule).select("rep").distinct().count() > 300
    left = {r.rep for r in minhash._partnered(sets, rule).collect()}
    assert left >= {400, 401} and len(left) < 40
