"""Expressions over digest texts: clean-up, sections, themes, sentiment, categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendloom.functions import constants, patterns

_BLANKS = r"[\s\p{Z}]+"


def _heading(name: str) -> str:
    """A bold heading with its colon inside, outside or missing."""
    return rf"\*\*{name}(?::\*\*|\*\*:?)"


def _section(name: str) -> str:
    return rf"(?is){_heading(name)}[\s\p{{Z}}]*(.+?)(?:\n\*\*|\z)"


def sanitize(text: Column) -> Column:
    """Real line breaks, no box-drawing characters, single blanks, bullets on their own line."""
    text = F.replace(text, F.lit("\\n"), F.lit("\n"))
    text = F.translate(text, "─│┌┐└┘", " |++++")
    text = F.regexp_replace(text, "  +", " ")
    text = F.regexp_replace(text, "([^\n])•", "$1\n•")
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+\z", "")


def sentiment(text: Column) -> Column:
    low = F.lower(text)
    bull, bear = F.contains(low, F.lit("bullish")), F.contains(low, F.lit("bearish"))
    return (
        F.when(bull & ~bear, "bullish")
        .when(bear & ~bull, "bearish")
        .when((bull & bear) | F.contains(low, F.lit("mixed")), "mixed")
        .otherwise("neutral")
    )


def trend_category(trend: Column) -> Column:
    low = F.lower(trend)
    return (
        F.when(trend.startswith("$"), "stock")
        .when(trend.startswith("#"), "hashtag")
        .when(low.rlike(patterns.any_of(constants.COMMODITY_KEYWORDS)), "commodity")
        .when(low.rlike(patterns.any_of(constants.SECTOR_KEYWORDS)), "sector")
        .otherwise("general")
    )


def trend_categories(trends: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(trends, trend_category)))


def themes(text: Column, limit: int = 10) -> Column:
    """Bullets of the trends section, then what the bottom line is about; first spelling wins."""
    observed = F.regexp_extract(
        text, rf"(?is){_heading('trends observed')}\s*\n(.*?)(?:\n\*\*|\z)", 1
    )
    bullets = F.regexp_extract_all(observed, F.lit(r"[-•][\s\p{Z}]*([^\n]+)"), F.lit(1))
    closing = F.regexp_extract(text, _section("(?:bottom line|summary)"), 1)
    about = F.regexp_extract_all(
        closing, F.lit(r"(?i)(?:about|regarding|concerning)[\s\p{Z}]+([^,.]+)"), F.lit(1)
    )
    found = F.transform(F.concat(bullets, about), _strip)
    found = F.filter(found, lambda t: F.length(t) > 3)
    lowered = F.transform(found, F.lower)
    first = F.filter(
        F.transform(
            found,
            lambda t, i: F.struct(
                t.alias("theme"), (F.array_position(lowered, F.lower(t)) == i + 1).alias("first")
            ),
        ),
        lambda s: s["first"],
    )
    return F.slice(F.transform(first, lambda s: s["theme"]), 1, limit)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+\z", "")


def summary(text: Column, limit: int = 500) -> Column:
    """Bottom line, else summary, else assessment, else the first paragraph."""

    def section(name: str) -> Column:
        body = F.regexp_replace(_strip(F.regexp_extract(text, _section(name), 1)), _BLANKS, " ")
        return F.nullif(body, F.lit(""))

    first_paragraph = F.split_part(text, F.lit("\n\n"), F.lit(1))
    return F.substring(
        F.coalesce(
            section("bottom line"), section("summary"), section("assessment"), first_paragraph
        ),
        1,
        limit,
    )


def memory_text(
    day: Column,
    signal: Column,
    mood: Column,
    trends: Column,
    categories: Column,
    theme_list: Column,
    summary_text: Column,
) -> Column:
    """The seven labelled lines under which a day is embedded."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Date: "), F.date_format(day, "yyyy-MM-dd")),
        F.concat(F.lit("Signal: "), signal),
        F.concat(F.lit("Sentiment: "), mood),
        F.concat(F.lit("Trends: "), F.array_join(trends, ", ")),
        F.concat(F.lit("Categories: "), F.array_join(categories, ", ")),
        F.concat(F.lit("Themes: "), F.array_join(theme_list, ", ")),
        F.concat(F.lit("Summary: "), summary_text),
    )


def query_text(trends: Column, theme_list: Column, mood: Column, signal: Column) -> Column:
    """The four labelled lines under which current conditions are searched."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Trends: "), F.array_join(trends, ", ")),
        F.concat(F.lit("Themes: "), F.array_join(theme_list, ", ")),
        F.concat(F.lit("Sentiment: "), mood),
        F.concat(F.lit("Signal: "), signal),
    )


def recovered_subject(text: Column) -> Column:
    """Subject from a free-text digest, null if it has none."""
    found = F.regexp_extract(
        text, r"""(?i)\*\*subject line\*\*:[\s\p{Z}]*["']?([^"'\n]+)["']?""", 1
    )
    return F.nullif(_strip(found), F.lit(""))


def recovered_signal(text: Column) -> Column:
    upper = F.upper(text)

    def says(word: str) -> Column:
        return F.contains(upper, F.lit(word)) & F.contains(upper, F.lit("SIGNAL"))

    return (
        F.when(says("HIGH"), "high")
        .when(says("MEDIUM"), "medium")
        .when(says("NONE"), "none")
        .otherwise("low")
    )


def recovered_body(text: Column) -> Column:
    """Free text without its subject and signal lines."""
    line = r"(?i)\*\*(?:subject line|signal strength)\*\*:[\s\p{Z}]*[^\n]*\n*"
    return _strip(F.regexp_replace(text, line, ""))
