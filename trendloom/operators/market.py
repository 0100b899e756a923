"""Quotes from daily bars, symbol look-up and claim checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions import constants, market, text


def month_bars(bars: DataFrame, as_of: dt.date) -> DataFrame:
    """Bars of the calendar month up to as_of."""
    return bars.where(
        (F.col("date") > F.add_months(F.lit(as_of), -1)) & (F.col("date") <= F.lit(as_of))
    )


def _pct(price: Column, base: Column) -> Column:
    return F.when(base != 0, (price - base) / base * 100)


def quotes(bars: DataFrame, as_of: dt.date, fetched_at: dt.datetime | None = None) -> DataFrame:
    """One quote per symbol with bars in the last month.

    Each figure is an aggregate over the year before as_of, so no bar history is sorted: the
    last six closes come from a list of one month's bars.
    """
    today = F.lit(as_of)
    year = bars.where(
        (F.col("date") > F.date_sub(today, 365)) & (F.col("date") <= today)
    )
    in_month = F.col("date") > F.add_months(today, -1)
    month = F.sort_array(
        F.collect_list(F.when(in_month, F.struct("date", "close", "volume"))), asc=False
    )
    summary = year.groupBy("symbol").agg(
        month.alias("m"),
        F.max("close").alias("high_52w"),
        F.min("close").alias("low_52w"),
    )
    n = F.size("m")
    price = F.col("m")[0]["close"]

    def back(steps: int) -> Column:
        return F.get("m", F.lit(steps))["close"]

    week_base = F.when(n >= 6, back(5)).when(n > 1, F.element_at("m", -1)["close"])
    last_ten = F.slice(F.col("m.volume"), 1, 10)
    return (
        summary.where(n > 0)
        .select(
            "symbol",
            F.col("symbol").alias("name"),
            price.alias("current_price"),
            F.when(n >= 2, price - back(1)).otherwise(0.0).alias("price_change_1d"),
            F.when(n >= 2, _pct(price, back(1))).otherwise(0.0).alias("price_change_1d_pct"),
            _pct(price, week_base).alias("price_change_5d_pct"),
            F.col("m")[0]["volume"].alias("volume"),
            F.floor(
                F.aggregate(last_ten, F.lit(0).cast("bigint"), lambda a, v: a + v)
                / F.size(last_ten)
            ).alias("avg_volume"),
            "high_52w",
            "low_52w",
            F.lit(None).cast("double").alias("market_cap"),
            F.lit(fetched_at).cast("timestamp_ntz").alias("fetched_at"),
        )
        .withColumn("category", market.category(F.col("symbol")))
    )


def bar_indicators(bars: DataFrame) -> DataFrame:
    """Changes, 52-week range and average volume at every bar of every symbol."""
    by_day = Window.partitionBy("symbol").orderBy("date")
    year = Window.partitionBy("symbol").orderBy("_day").rangeBetween(-364, 0)
    numbered = bars.withColumn("_day", F.datediff("date", F.lit(dt.date(1970, 1, 1))))
    previous = F.lag("close", 1).over(by_day)
    week = F.lag("close", 5).over(by_day)
    return numbered.select(
        "symbol",
        "date",
        "close",
        "volume",
        F.coalesce(F.col("close") - previous, F.lit(0.0)).alias("change_1d"),
        F.coalesce(_pct(F.col("close"), previous), F.lit(0.0)).alias("change_1d_pct"),
        _pct(F.col("close"), week).alias("change_5d_pct"),
        F.max("close").over(year).alias("high_52w"),
        F.min("close").over(year).alias("low_52w"),
        F.floor(F.avg("volume").over(by_day.rowsBetween(-9, 0))).alias("avg_volume"),
    )


def latest_bars(bars: DataFrame) -> DataFrame:
    """Newest bar per symbol, combined on the map side."""
    newest = F.max_by(F.struct("date", "close", "volume"), "date").alias("b")
    return bars.groupBy("symbol").agg(newest).select("symbol", "b.*")


def with_flags(quote_rows: DataFrame) -> DataFrame:
    price, volume, average = F.col("current_price"), F.col("volume"), F.col("avg_volume")
    high, low = F.col("high_52w"), F.col("low_52w")
    return (
        quote_rows.withColumn("is_near_52w_high", market.near_high(price, high))
        .withColumn("is_near_52w_low", market.near_low(price, low))
        .withColumn("is_unusual_volume", market.unusual_volume(volume, average))
        .withColumn("volume_ratio", market.volume_ratio(volume, average))
        .withColumn("notes", market.quote_notes(price, high, low, volume, average))
    )


def trend_symbols(trends: DataFrame) -> DataFrame:
    """(term, symbol) pairs of the trends that name a market symbol."""
    return trends.select("term", F.explode(market.symbols_of(F.col("term"))).alias("symbol"))


def requested_symbols(trends: DataFrame) -> DataFrame:
    """Distinct symbols; if no trend names one, upper-case names of up to 5 characters stand in."""
    named = trend_symbols(trends).select("symbol").distinct()
    upper = trends.where(
        (F.length("term") <= 5)
        & (F.col("term") == F.upper("term"))
        & (F.col("term") != F.lower("term"))
    )
    spare = upper.select(F.col("term").alias("symbol")).distinct()
    return named.unionByName(spare.where(~named.exists()))


def with_common_symbols(symbols: DataFrame) -> DataFrame:
    """The symbols plus those always quoted for context."""
    spark = symbols.sparkSession
    common = spark.range(1).select(
        F.explode(F.array(*[F.lit(s) for s in constants.COMMON_SYMBOLS])).alias("symbol")
    )
    return symbols.select("symbol").unionByName(common).distinct()


def fresh_quotes(quote_log: DataFrame, as_of: dt.datetime, ttl_minutes: int = 5) -> DataFrame:
    """Latest logged quote per symbol that is younger than the time to live."""
    oldest = as_of - dt.timedelta(minutes=ttl_minutes)
    rows = quote_log.where(
        (F.col("fetched_at") > F.lit(oldest).cast("timestamp_ntz"))
        & (F.col("fetched_at") <= F.lit(as_of).cast("timestamp_ntz"))
    )
    columns = [c for c in quote_log.columns if c != "symbol"]
    return (
        rows.groupBy("symbol")
        .agg(F.max_by(F.struct(*columns), F.struct("fetched_at", "current_price")).alias("q"))
        .select("symbol", "q.*")
    )


def quote_validity(quote_log: DataFrame, ttl_minutes: int = 5) -> DataFrame:
    """Quotes with the span they answer for, one row per time bucket the span touches.

    A quote is valid until the next quote of its symbol and no longer than its time to live.
    Buckets as wide as the time to live split a hot symbol into small join groups.
    """
    ttl = ttl_minutes * 60_000_000
    at = F.unix_micros(F.col("fetched_at").cast("timestamp"))
    by_time = Window.partitionBy("symbol", "bucket").orderBy("at", "quote_id")
    numbered = quote_log.select(
        "symbol", "current_price", "fetched_at", "quote_id", at.alias("at")
    ).withColumn("bucket", F.floor(F.col("at") / ttl))
    # The next quote matters only within the time to live: it lies in this bucket or the next.
    first_of_bucket = numbered.groupBy("symbol", (F.col("bucket") - 1).alias("bucket")).agg(
        F.min("at").alias("next_bucket_at")
    )
    spans = (
        numbered.withColumn("next_at", F.lead("at").over(by_time))
        .join(first_of_bucket, ["symbol", "bucket"], "left")
        .withColumn("until", F.least(F.coalesce("next_at", "next_bucket_at"), F.col("at") + ttl))
    )
    return spans.select(
        "symbol",
        "current_price",
        "fetched_at",
        F.col("at").alias("valid_from"),
        F.col("until").alias("valid_until"),
        F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"),
    )


def quotes_at_mention(
    posts: DataFrame, quote_log: DataFrame, ttl_minutes: int = 5
) -> DataFrame:
    """Ticker mentions with the newest quote fresh at the time of the post, if there is one.

    Works on a table and on a stream of posts; the quote log is a table.
    """
    ttl = ttl_minutes * 60_000_000
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    named = (
        posts.where(~F.col("is_retweet"))
        .select(
            "id",
            "created_at",
            F.explode(F.array_distinct(text.cashtags(F.col("text")))).alias("symbol"),
        )
        .withColumn("posted_at", at)
        .withColumn("bucket", F.floor(F.col("posted_at") / ttl))
    )
    spans = quote_validity(quote_log, ttl_minutes)
    valid = (
        (named["symbol"] == spans["symbol"])
        & (named["bucket"] == spans["bucket"])
        & (named["posted_at"] >= spans["valid_from"])
        & (named["posted_at"] < spans["valid_until"])
    )
    return named.join(spans, valid, "left").select(
        named["id"], named["created_at"], named["symbol"], "current_price", "fetched_at"
    )


def stale_symbols(symbols: DataFrame, fresh: DataFrame) -> DataFrame:
    """Requested symbols without a fresh quote."""
    return symbols.select("symbol").distinct().join(fresh.select("symbol"), "symbol", "left_anti")


def trend_quotes(trends: DataFrame, quote_rows: DataFrame) -> DataFrame:
    """Quote context of each trend: symbol, figures, flags and notes."""
    return trend_symbols(trends).join(with_flags(quote_rows), "symbol")


def category_summary(quote_rows: DataFrame) -> DataFrame:
    """Symbols per category with mean and extreme moves."""
    return quote_rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_symbols"),
        F.max("price_change_1d_pct").alias("best_1d_pct"),
        F.min("price_change_1d_pct").alias("worst_1d_pct"),
    )


def claims(posts: DataFrame) -> DataFrame:
    """One row per claim of a post, numbered in the order of its text, bound to its ticker."""
    # Cheap tests first: most posts hold no ticker, percentage or volume word at all.
    possible = F.col("text").contains("%") | F.lower("text").rlike("volume|high")
    stated = posts.where(~F.col("is_retweet") & possible & text.has_cashtag(F.col("text")))
    return stated.select("id", F.posexplode(market.stated_claims(F.col("text"))).alias("claim_number", "c")).select(
        "id", "claim_number", "c.*"
    )


def checked_claims(
    claim_rows: DataFrame, quote_rows: DataFrame, tolerance_pct: float = 2.0
) -> DataFrame:
    """Every claim with its verdict: VERIFIED, EXAGGERATED, FALSE or UNVERIFIED."""
    facts = with_flags(quote_rows).select(
        "symbol", "price_change_1d_pct", "is_unusual_volume", "is_near_52w_high"
    )
    known, kind = F.col("price_change_1d_pct"), F.col("kind")
    verdict = F.coalesce(
        market.move_verdict(F.when(kind == "move", F.col("claimed_pct")), known, tolerance_pct),
        market.flag_verdict(kind == "volume", known, F.col("is_unusual_volume")),
        market.flag_verdict(kind == "high", known, F.col("is_near_52w_high")),
    )
    return claim_rows.join(facts, "symbol", "left").select(
        "id", "claim_number", "symbol", "kind", "claimed_pct", known.alias("actual_pct"), verdict.alias("verdict")
    )
