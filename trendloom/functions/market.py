"""Symbol lookup, quote flags and claim verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendloom.functions import constants, patterns


def _first_symbol(term: Column, table: tuple[tuple[str, str], ...], whole_word: bool) -> Column:
    """Symbol of the first keyword of the table found in the term, null if none."""

    def hit(keyword: str) -> Column:
        if whole_word:
            return F.array_contains(F.split(F.btrim(term), r"[\s\p{Z}]+"), keyword)
        return F.contains(term, F.lit(keyword))

    (first, symbol), *rest = table
    return reduce(
        lambda chain, row: chain.when(hit(row[0]), row[1]), rest, F.when(hit(first), symbol)
    )


def symbols_of(trend: Column) -> Column:
    """Market symbols meant by a trend name: its ticker, or one symbol per matching family."""
    name = F.btrim(F.lower(trend))
    ticker = F.regexp_extract(trend, r"^\$([A-Za-z]{1,5})$", 1)
    families = F.array(
        _first_symbol(name, constants.COMMODITY_SYMBOLS, whole_word=False),
        _first_symbol(name, constants.CRYPTO_SYMBOLS, whole_word=True),
        _first_symbol(name, constants.INDEX_SYMBOLS, whole_word=False),
        _first_symbol(name, constants.SECTOR_SYMBOLS, whole_word=False),
    )
    return F.when(ticker != "", F.array(F.upper(ticker))).otherwise(
        F.array_distinct(F.array_compact(families))
    )


def category(symbol: Column) -> Column:
    etfs = sorted({s for _, s in constants.SECTOR_SYMBOLS})
    return (
        F.when(symbol.endswith("=F"), "commodity")
        .when(symbol.endswith("-USD"), "crypto")
        .when(symbol.startswith("^"), "index")
        .when(symbol.isin(*etfs), "etf")
        .otherwise("stock")
    )


def near_high(price: Column, high: Column) -> Column:
    return (high > 0) & (price >= high * 0.95)


def near_low(price: Column, low: Column) -> Column:
    return (low > 0) & (price <= low * 1.05)


def unusual_volume(volume: Column, average: Column) -> Column:
    return (average > 0) & (volume > average * 2)


def volume_ratio(volume: Column, average: Column) -> Column:
    return F.when(average > 0, volume / average).otherwise(0.0)


def quote_notes(price: Column, high: Column, low: Column, volume: Column, average: Column) -> Column:
    notes = F.concat_ws(
        ", ",
        F.when(near_high(price, high), "Near 52w High"),
        F.when(near_low(price, low), "Near 52w Low"),
        F.when(unusual_volume(volume, average), "High Volume"),
    )
    return F.coalesce(F.nullif(notes, F.lit("")), F.lit("-"))


# The claim rule is this library's own: which words state a move, its size, volume or a high.
UP_WORDS = ("up", "gain", "gains", "gained", "rally", "rallied", "soaring", "jumped")
DOWN_WORDS = ("down", "drop", "dropped", "fell", "crash", "crashing", "crashed", "plunged")
VOLUME_WORDS = ("huge volume", "massive volume", "heavy volume", "record volume")
HIGH_WORDS = ("52w high", "52-week high", "all-time high")


_NUMBER = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"
_MOVE = patterns.any_of(UP_WORDS + DOWN_WORDS, whole_word=True) + rf"\s+{_NUMBER}\s?%"
_VOLUME, _HIGH = patterns.any_of(VOLUME_WORDS), patterns.any_of(HIGH_WORDS)
_CLAIM = f"{_MOVE}|{_VOLUME}|{_HIGH}"
_TICKER_AHEAD = f"(?={patterns.CASHTAG})"


def _claim(found: Column, symbol: Column) -> Column:
    """What a matched phrase claims about a symbol."""
    number = F.regexp_replace(F.regexp_extract(found, rf"({_NUMBER})\s?%$", 1), ",", "")
    size = F.nullif(number, F.lit("")).cast("double")
    falls = found.rlike("^" + patterns.any_of(DOWN_WORDS, whole_word=True))
    return F.struct(
        symbol.alias("symbol"),
        F.when(found.endswith("%"), "move").when(found.rlike(_VOLUME), "volume").otherwise("high").alias("kind"),
        F.when(falls, -size).otherwise(size).alias("claimed_pct"),
    )


def stated_claims(text: Column) -> Column:
    """Every claim of a text in its order: symbol, kind (move, volume, high) and signed percentage.

    A claim is about the nearest ticker before it, or about the first one where none precedes. The
    text is cut in front of its tickers, so every part is searched once and knows its ticker.
    """
    ticker = lambda part: F.nullif(F.upper(F.regexp_extract(part, patterns.CASHTAG, 1)), F.lit(""))
    parts = F.split(text, _TICKER_AHEAD)
    claims = F.transform(
        parts,
        lambda part: F.transform(
            F.regexp_extract_all(F.lower(part), F.lit(_CLAIM), F.lit(0)),
            lambda found: _claim(found, F.coalesce(ticker(part), ticker(text))),
        ),
    )
    return F.flatten(claims)


def move_verdict(claimed_pct: Column, actual_pct: Column, tolerance_pct: float = 2.0) -> Column:
    return (
        F.when(claimed_pct.isNull(), F.lit(None).cast("string"))
        .when(actual_pct.isNull(), "UNVERIFIED")
        .when(F.signum(claimed_pct) * F.signum(actual_pct) < 0, "FALSE")
        .when(F.abs(claimed_pct) > F.abs(actual_pct) + tolerance_pct, "EXAGGERATED")
        .otherwise("VERIFIED")
    )


def flag_verdict(claimed: Column, known: Column, holds: Column) -> Column:
    """Verdict of a yes/no claim (volume, 52-week high) against a quote flag."""
    return F.when(
        claimed,
        F.when(known.isNull(), "UNVERIFIED").when(holds, "VERIFIED").otherwise("EXAGGERATED"),
    )
