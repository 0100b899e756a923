from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trendloom.functions import market as fm
from trendloom.operators import market


def terms(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "term STRING")


def symbols(spark, *names):
    rows = market.trend_symbols(terms(spark, *names)).collect()
    return {(r.term, r.symbol) for r in rows}


def test_symbol_lookup(spark):
    assert symbols(spark, "$NVDA", "$aapl", "random text") == {("$NVDA", "NVDA"), ("$aapl", "AAPL")}
    found = {s for _, s in symbols(spark, "gold", "silver prices", "oil market")}
    assert found == {"GC=F", "SI=F", "CL=F"}
    assert {s for _, s in symbols(spark, "bitcoin", "ethereum rally")} == {"BTC-USD", "ETH-USD"}
    assert {s for _, s in symbols(spark, "s&p 500", "nasdaq", "dow jones")} == {"^GSPC", "^IXIC", "^DJI"}
    # one symbol per family, the first keyword wins; crypto needs the whole word
    assert symbols(spark, "crude oil and gold energy") == {
        ("crude oil and gold energy", "GC=F"), ("crude oil and gold energy", "XLE"),
    }
    assert symbols(spark, "adapter method") == set()


def test_requested_symbols_fall_back_to_names(spark):
    asked = [r.symbol for r in market.requested_symbols(terms(spark, "MSFT", "hello", "TOOLONG")).collect()]
    assert asked == ["MSFT"]
    asked = [r.symbol for r in market.requested_symbols(terms(spark, "MSFT", "gold")).collect()]
    assert asked == ["GC=F"]


@pytest.mark.parametrize(
    ("symbol", "category"),
    [("GC=F", "commodity"), ("BTC-USD", "crypto"), ("^GSPC", "index"), ("XLE", "etf"), ("NVDA", "stock")],
)
def test_category(spark, symbol, category):
    assert spark.range(1).select(fm.category(F.lit(symbol))).first()[0] == category


def bars(spark, closes, symbol="X", end=dt.date(2024, 1, 31)):
    rows = [
        (symbol, end - dt.timedelta(days=len(closes) - 1 - i), float(c), 100 * (i + 1))
        for i, c in enumerate(closes)
    ]
    return spark.createDataFrame(rows, "symbol STRING, date DATE, close DOUBLE, volume BIGINT")


def test_quote_changes(spark):
    quote = market.quotes(bars(spark, [100, 101, 102, 103, 104, 110]), dt.date(2024, 1, 31)).first()
    assert quote.price_change_1d == 6.0
    assert quote.price_change_5d_pct == pytest.approx(10.0)
    assert quote.volume == 600
    assert quote.avg_volume == 350
    short = market.quotes(bars(spark, [100, 120, 90]), dt.date(2024, 1, 31)).first()
    assert short.price_change_5d_pct == pytest.approx(-10.0)
    single = market.quotes(bars(spark, [100]), dt.date(2024, 1, 31)).first()
    assert (single.price_change_1d, single.price_change_1d_pct, single.price_change_5d_pct) == (0, 0, None)


def test_symbols_without_bars_in_the_month_are_omitted(spark):
    old = bars(spark, [5, 6], end=dt.date(2023, 11, 1))
    assert market.quotes(old, dt.date(2024, 1, 31)).count() == 0


def test_flags(spark):
    row = spark.range(1).select(
        fm.near_high(F.lit(95.0), F.lit(100.0)).alias("h"),
        fm.near_high(F.lit(95.0), F.lit(0.0)).alias("h0"),
        fm.near_low(F.lit(52.5), F.lit(50.0)).alias("l"),
        fm.unusual_volume(F.lit(201), F.lit(100)).alias("v"),
        fm.unusual_volume(F.lit(201), F.lit(0)).alias("v0"),
        fm.volume_ratio(F.lit(250), F.lit(100)).alias("r"),
        fm.volume_ratio(F.lit(250), F.lit(0)).alias("r0"),
        fm.quote_notes(F.lit(99.0), F.lit(100.0), F.lit(1.0), F.lit(300), F.lit(100)).alias("n"),
        fm.quote_notes(F.lit(50.0), F.lit(100.0), F.lit(1.0), F.lit(3), F.lit(100)).alias("n0"),
    ).first()
    assert row.asDict() == {
        "h": True, "h0": False, "l": True, "v": True, "v0": False, "r": 2.5, "r0": 0.0,
        "n": "Near 52w High, High Volume", "n0": "-",
    }


def test_claims(spark):
    posts = spark.createDataFrame(
        [
            (1, "$X up 12% today", False),
            (2, "$X crashing 8% now", False),
            (3, "$X up 5%", False),
            (4, "$Y up 5% on massive volume", False),
            (5, "$X at a 52w high", False),
            (6, "$X up 12%", True),
            (7, "$X is nice", False),
        ],
        "id LONG, text STRING, is_retweet BOOLEAN",
    )
    quote = market.quotes(bars(spark, [100, 101, 102, 103, 100, 106]), dt.date(2024, 1, 31))
    rows = sorted(market.checked_claims(market.claims(posts), quote).collect())
    assert [(r.id, r.kind, r.verdict) for r in rows] == [
        (1, "move", "EXAGGERATED"), (2, "move", "FALSE"), (3, "move", "VERIFIED"), (4, "move", "UNVERIFIED"),
        (4, "volume", "UNVERIFIED"), (5, "high", "VERIFIED"),
    ]


@pytest.mark.parametrize(
    ("text", "stated"),
    [
        ("$NVDA down 5% after being up 2%", [("NVDA", -5.0), ("NVDA", 2.0)]),
        ("$NVDA up 12%, $TSLA down 8%", [("NVDA", 12.0), ("TSLA", -8.0)]),
        ("up 12345% then up 1,200% and fell 0.5 % $gme", [("GME", 12345.0), ("GME", 1200.0), ("GME", -0.5)]),
        ("gold at a 52w high, massive volume $GLD $SLV", [("GLD", None), ("GLD", None)]),
        ("$A $B jumped 3% and $C", [("B", 3.0)]),
        ("$A pickup 3% upto 5%", []),
        ("$TOOLONG up 3%", []),
        ("up 3%", []),
    ],
)
def test_every_claim_has_its_ticker(spark, text, stated):
    posts = spark.createDataFrame([(1, text, False)], "id LONG, text STRING, is_retweet BOOLEAN")
    rows = market.claims(posts).orderBy("claim_number").collect()
    assert [(r.symbol, r.claimed_pct) for r in rows] == stated
    assert [r.claim_number for r in rows] == list(range(len(stated)))


def test_fresh_and_stale_quotes(spark):
    at = dt.datetime(2024, 1, 1, 12, 0)
    log = spark.createDataFrame(
        [
            ("A", 1.0, at - dt.timedelta(minutes=6)),
            ("A", 2.0, at - dt.timedelta(minutes=4)),
            ("A", 3.0, at - dt.timedelta(minutes=1)),
            ("B", 9.0, at - dt.timedelta(minutes=5)),
        ],
        "symbol STRING, current_price DOUBLE, fetched_at TIMESTAMP_NTZ",
    )
    fresh = market.fresh_quotes(log, at)
    assert [(r.symbol, r.current_price) for r in fresh.collect()] == [("A", 3.0)]
    asked = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol STRING")
    assert {r.symbol for r in market.stale_symbols(asked, fresh).collect()} == {"B", "C"}


def test_quotes_at_mention_equal_loop(spark):
    start = dt.datetime(2024, 1, 1)
    quotes = [(s, float(i), start + dt.timedelta(seconds=97 * i * (1 + i % 5)), i) for i in range(200) for s in "AB"]
    quotes.append(("A", 999.0, quotes[40][2], 10_000))  # same time, later number
    posts = [(i, start + dt.timedelta(seconds=61 * i), f"${'AB'[i % 2]} and $C", False) for i in range(400)]
    q = spark.createDataFrame(
        quotes, "symbol STRING, current_price DOUBLE, fetched_at TIMESTAMP_NTZ, quote_id LONG"
    )
    p = spark.createDataFrame(posts, "id LONG, created_at TIMESTAMP_NTZ, text STRING, is_retweet BOOLEAN")
    got = {(r.id, r.symbol): r.current_price for r in market.quotes_at_mention(p, q).collect()}
    assert len(got) == 800
    for i, at, _, _ in posts:
        symbol = "AB"[i % 2]
        live = [
            (t, n, price) for s, price, t, n in quotes if s == symbol and at - dt.timedelta(minutes=5) < t <= at
        ]
        assert got[(i, symbol)] == (max(live)[2] if live else None)
        assert got[(i, "C")] is None
