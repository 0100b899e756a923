"""Text expressions: cleaning, cashtags, noise and context tests, n-grams."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from trendloom.functions import constants, patterns


@dataclass(frozen=True)
class TermRules:
    """Vocabulary and matching mode of the term tests."""

    noise_terms: tuple[str, ...] = constants.NOISE_TERMS
    stop_words: tuple[str, ...] = constants.STOP_WORDS
    context_terms: tuple[str, ...] = constants.CONTEXT_TERMS
    match: str = "substring"  # or "word"

    @cached_property
    def alone(self) -> tuple[str, ...]:
        """Terms that are noise only when they stand alone."""
        short = [t for t in self.noise_terms if len(t) <= 3 or self.match == "word"]
        return tuple(dict.fromkeys([*short, *self.stop_words]))

    def _inside(self, terms: list[str]) -> str:
        if self.match == "word":
            return patterns.any_of(terms, whole_word=True) + r"|http|www|\.com"
        return patterns.any_of([*terms, "http", "www", ".com"])

    @cached_property
    def inside(self) -> str:
        """Pattern of the noise found anywhere inside a term."""
        return self._inside([t for t in self.noise_terms if len(t) > 3])

    @cached_property
    def inside_word(self) -> str:
        """Pattern of the noise found inside a single word."""
        return self._inside([t for t in self.noise_terms if len(t) > 3 and " " not in t])

    @cached_property
    def phrases(self) -> str | None:
        """Pattern of the noise phrases, which only a multi-word term can contain."""
        parts = [t for t in self.noise_terms if " " in t]
        return patterns.any_of(parts, whole_word=self.match == "word") if parts else None

    @cached_property
    def context(self) -> str:
        return patterns.any_of(self.context_terms, whole_word=self.match == "word")


DEFAULT_RULES = TermRules()


def load_terms(spark: SparkSession, path: str, limit: int = 20_000) -> tuple[str, ...]:
    """Read a word list, one term per line. A list becomes part of the plan, so it is bounded."""
    rows = spark.read.text(path).select(F.lower(F.trim("value")).alias("t")).where("t <> ''")
    terms = [r.t for r in rows.distinct().limit(limit + 1).collect()]
    if len(terms) > limit:
        raise ValueError(f"word list {path} has more than {limit} terms")
    return tuple(sorted(terms))


def normalized_key(term: Column) -> Column:
    """Lower case without leading or trailing $ and #."""
    return F.btrim(F.lower(term), F.lit("$#"))


def clean_text(text: Column) -> Column:
    """Drop URLs and mentions, keep words, $, #, apostrophes and hyphens, collapse blanks."""
    text = F.regexp_replace(text, r"https?://[^\s\p{Z}]+", "")
    text = F.regexp_replace(text, r"@[\p{L}\p{N}_]+", "")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}_$#'-]+", " ")
    return F.btrim(text)


def cashtags(text: Column) -> Column:
    """All ticker symbols in the text, upper case, repeats kept."""
    found = F.regexp_extract_all(text, F.lit(patterns.CASHTAG), F.lit(1))
    return F.transform(found, F.upper)


def has_cashtag(text: Column) -> Column:
    return text.rlike(patterns.CASHTAG)


def has_context(text: Column, rules: TermRules = DEFAULT_RULES) -> Column:
    """The text has a cashtag or an economic word."""
    return has_cashtag(text) | F.lower(text).rlike(rules.context)


def _is_number(term: Column) -> Column:
    return term.rlike(r"^[.,%$]*\p{Nd}[\p{Nd}.,%$]*$")


def is_noise(term: Column, rules: TermRules = DEFAULT_RULES) -> Column:
    """The term carries no signal: too short, a number, a URL or a noise word."""
    term = F.btrim(F.lower(term))
    return (
        (F.length(term) < 2)
        | term.isin(*rules.alone)
        | _is_number(term)
        | term.rlike(rules.inside)
    )


def hashtag_keys(hashtags: Column, rules: TermRules = DEFAULT_RULES) -> Column:
    """Usable hashtags, lower case without '#', 3 to 25 characters."""
    keys = F.transform(hashtags, lambda h: F.btrim(F.lower(h), F.lit("#")))
    return F.filter(keys, lambda k: F.length(k).between(3, 25) & ~is_noise(k, rules))


def cashtag_keys(text: Column, rules: TermRules = DEFAULT_RULES) -> Column:
    return F.filter(cashtags(text), lambda t: ~is_noise(t, rules))


BREAK = "|"


def term_line(text: Column, rules: TermRules = DEFAULT_RULES) -> Column:
    """Lower-case words of a text, one blank apart; a word no term may contain is a break.

    Such words hold a noise term or have no letter or digit. One replacement over the whole text
    finds them all, where a test per word would start the pattern a hundred times per post.
    """
    low = F.lower(clean_text(text))
    unusable = rf"(?<![^ ])(?:[^ ]*?(?:{rules.inside_word})[^ ]*|[^ \p{{L}}\p{{N}}]+(?![^ ]))"
    return F.regexp_replace(low, unusable, BREAK)


def inner_words(line: Column) -> Column:
    """Words of a term line, null at breaks: these may stand inside a phrase."""
    return F.transform(F.split(line, " "), lambda w: F.nullif(w, F.lit(BREAK)))


def outer_words(inner: Column, rules: TermRules = DEFAULT_RULES) -> Column:
    """Inner words, null at stop words: these may start or end a phrase."""
    return F.transform(inner, lambda w: F.when(~w.isin(*rules.stop_words), w))


def _join(left: Column, right: Column) -> Column:
    return F.concat(left, F.lit(" "), right)


def ngram_keys(
    line: Column, inner: Column, outer: Column, rules: TermRules = DEFAULT_RULES
) -> Column:
    """Distinct 1- to 3-word terms of a post, from its term line and the words of that line.

    A term neither starts nor ends with a stop word, and a single word has three characters.
    Nulls spread: a phrase with a break, or with a stop word at its edge, becomes null. The
    arguments are used several times, so they should be columns, not expressions.
    """
    size = F.greatest(F.size(outer), F.lit(1))
    ones = F.filter(
        outer, lambda w: (F.length(w) >= 3) & ~w.isin(*rules.alone) & (w.between("a", "z~") | ~_is_number(w))
    )  # a word that begins with a to z is no number and needs no pattern
    second = F.slice(outer, F.lit(2), size)
    twos = F.zip_with(outer, second, _join)
    heads = F.zip_with(outer, F.slice(inner, F.lit(2), size), _join)
    threes = F.zip_with(heads, F.slice(outer, F.lit(3), size), _join)
    phrases = F.concat(twos, threes)
    if rules.phrases:
        # Noise phrases are rare: only a line that holds one has its phrases tested.
        tested = F.filter(phrases, lambda g: ~g.rlike(rules.phrases))
        phrases = F.when(line.rlike(rules.phrases), tested).otherwise(phrases)
    return F.array_distinct(F.array_compact(F.concat(ones, phrases)))
