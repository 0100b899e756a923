"""N-gram terms of many posts at once, by numbers of words in place of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendloom.functions import patterns, text
from trendloom.functions.text import DEFAULT_RULES, TermRules

#: Literal terms in one pattern: Arrow bounds the size of a compiled one.
PATTERN_TERMS = 1000
#: Words of the posts that are handled together: their numbers and terms stay small.
SLICE_WORDS = 200_000


def _any_of(terms: list[str], whole_word: bool) -> list[str]:
    """Patterns without look-around, of which one at least is found where ``patterns.any_of`` finds a term."""
    lists = [terms[i : i + PATTERN_TERMS] for i in range(0, len(terms), PATTERN_TERMS)]
    joined = ["|".join("".join(map(patterns.literal, t)) for t in some) for some in lists]
    edge = r"[^\p{L}\p{N}_]"
    return [rf"(?:^|{edge})(?:{p})(?:{edge}|$)" if whole_word else p for p in joined]


def _joining():
    """A function that spells the terms of n + 1 words that begin at places; it stands on its own."""

    def joined(words, code, place, n):
        import pyarrow as pa
        import pyarrow.compute as pc

        parts = [words.take(pa.array(code[place + j])) for j in range(n + 1)]
        return pc.binary_join_element_wise(*parts, " ") if n else parts[0]

    return joined


def places_of_lines(rules: TermRules = DEFAULT_RULES, most: int | None = None):
    """A function that gives the terms of lines by their places.

    These are the different words, the number of the word and that of the line at each place of a word, and the places where a
    term of one, of two and of three words begins; each term of a line comes once. It gives them by slices of
    lines and stands on its own, so that executors need no package for it.
    """

    most, _joined = most or SLICE_WORDS, _joining()

    whole_word = rules.match == "word"
    stop_words, alone = rules.stop_words, rules.alone
    inside = [t for t in rules.noise_terms if len(t) > 3 and " " not in t]
    unusable = [*_any_of(inside, whole_word), *_any_of(["http", "www", ".com"], False), r"^[^\p{L}\p{N}]+$"]
    noise_phrases = _any_of([t for t in rules.noise_terms if " " in t], whole_word)

    def run(lines):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def distinct(post, first, *more):
            """The first places of equal rows; numbers are ranked before they are combined, so that none overflows."""
            key = first.astype(np.int64)
            for other in more:
                key = np.unique(key, return_inverse=True)[1] * (int(other.max(initial=0)) + 1) + other
            key = key * (int(post.max(initial=0)) + 1) + post
            return np.sort(np.unique(key, return_index=True)[1])

        def found(some, any_of):
            met = np.zeros(len(some), bool)
            for pattern in any_of:
                met |= pc.fill_null(pc.match_substring_regex(some, pattern), False).to_numpy(zero_copy_only=False)
            return met

        def places(lines):
            split = pc.split_pattern(lines, " ")
            at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False))])
            coded = split.flatten().dictionary_encode()
            words, code = coded.dictionary, coded.indices.to_numpy()
            plain = pc.and_(pc.greater_equal(words, "a"), pc.less_equal(words, "z~"))  # no number, so it needs no pattern
            number = pc.match_substring_regex(words, r"^[.,%$]*\p{Nd}[\p{Nd}.,%$]*$")
            listed = pc.is_in(words, value_set=pa.array(alone, pa.string()))
            whole = pc.and_(pc.greater_equal(pc.utf8_length(words), 3), pc.and_(pc.invert(listed), pc.or_(plain, pc.invert(number))))
            inner = ~found(words, unusable)
            outer = inner & ~pc.is_in(words, value_set=pa.array(stop_words, pa.string())).to_numpy(zero_copy_only=False)
            whole = outer & whole.to_numpy(zero_copy_only=False)
            inner, outer, whole = inner[code], outer[code], whole[code]
            post = np.repeat(np.arange(len(lines)), np.diff(at))
            ones = np.flatnonzero(whole)
            twos = np.flatnonzero(outer[:-1] & outer[1:] & (post[:-1] == post[1:]))
            threes = np.flatnonzero(outer[:-2] & inner[1:-1] & outer[2:] & (post[:-2] == post[2:]))
            noisy = found(lines, noise_phrases)[post]  # only a line that holds a noise phrase has its terms tested
            begins = []
            for n, place in enumerate((ones, twos, threes)):
                place = place[distinct(post[place], *(code[place + j] for j in range(n + 1)))]
                rare = np.flatnonzero(noisy[place])
                if len(rare):
                    made = _joined(words, code, place[rare], n)
                    left = np.ones(len(place), bool)
                    left[rare] = ~found(made, noise_phrases)
                    place = place[left]
                begins.append(place)
            return words, code, post, begins

        lines = lines.cast(pa.string())
        blanks = np.cumsum(pc.fill_null(pc.count_substring(lines, " "), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        cuts = [0, *(np.flatnonzero(np.diff(blanks // most)) + 1).tolist(), len(lines)] if len(lines) else []
        for a, b in zip(cuts, cuts[1:]):
            words, code, post, begins = places(lines.slice(a, b - a))
            yield words, code, post + a, begins

    return run


def terms_of_lines(rules: TermRules = DEFAULT_RULES, most: int | None = None):
    """A function that gives the terms of lines: places of their lines, and terms. It gives them by slices and stands on its own."""
    places, _joined = places_of_lines(rules, most), _joining()

    def run(lines):
        import numpy as np
        import pyarrow as pa

        for words, code, post, begins in places(lines):
            made = [_joined(words, code, place, n) for n, place in enumerate(begins)]
            yield np.concatenate([post[place] for place in begins]), pa.concat_arrays(made)

    return run


def _keys_of_lines(rules: TermRules):
    """An Arrow function that stands on its own, as above."""
    terms = terms_of_lines(rules)

    def run(lines):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        found = list(terms(lines))
        if not found:
            return pa.array([], pa.list_(pa.string()))
        owners, made = np.concatenate([f[0] for f in found]), pa.concat_arrays([f[1] for f in found])
        ends = np.cumsum(np.bincount(owners, minlength=len(lines)))
        empty = np.append(pc.is_null(lines).to_numpy(zero_copy_only=False), False)
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=empty)
        return pa.ListArray.from_arrays(offsets, made.take(pa.array(np.argsort(owners, kind="stable"))))

    return run


def term_lines(content: Column) -> Column:
    """The lines that ``terms_of_lines`` takes."""
    return F.lower(text.clean_text(content))


def text_keys(content: Column, rules: TermRules = DEFAULT_RULES) -> Column:
    """What ``text.ngram_keys`` gives for the term line and words of a text, in the same order.

    The words of a batch of posts are numbered, tests are made once for each different word, and terms are
    compared as numbers; only terms that are left become texts.
    """
    made = F.arrow_udf(_keys_of_lines(rules), "array<string>")
    return made(term_lines(content))
