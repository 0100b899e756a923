"""Building blocks of the checking SQL (DuckDB dialect).

Written independently of the DataFrame code: flat alternations, unnested words, plain windows.
"""

from __future__ import annotations

import re

from trendloom.functions import constants
from trendloom.plans import testdata


def quoted(terms) -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in terms)


def flat(terms) -> str:
    """A plain alternation of literals."""
    return "|".join(re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", t) for t in terms).replace("'", "''")


NOISE_INSIDE = flat([t for t in constants.NOISE_TERMS if len(t) > 3] + ["http", "www", ".com"])
NOISE_ALONE = quoted([t for t in constants.NOISE_TERMS if len(t) <= 3] + list(constants.STOP_WORDS))
NOISE_PHRASES = flat([t for t in constants.NOISE_TERMS if " " in t])
STOPS = quoted(constants.STOP_WORDS)
NUMBER = r"^[.,%$]*\p{Nd}[\p{Nd}.,%$]*$"


def noise(x: str) -> str:
    return (
        f"(length({x}) < 2 OR {x} IN ({NOISE_ALONE}) OR regexp_matches({x}, '{NUMBER}') "
        f"OR regexp_matches({x}, '{NOISE_INSIDE}'))"
    )


def cashtags(x: str) -> str:
    spaced = rf"regexp_replace({x}, '\$', ' $', 'g')"
    found = rf"regexp_extract_all({spaced}, '\$([A-Za-z]{{1,5}})(?:[^\p{{L}}\p{{N}}_]|$)', 1)"
    return f"list_transform({found}, lambda t: upper(t))"


def has_context(x: str) -> str:
    return (
        f"(len({cashtags(x)}) > 0 OR regexp_matches(lower({x}), '{flat(constants.CONTEXT_TERMS)}'))"
    )


def clean(x: str) -> str:
    x = rf"regexp_replace({x}, 'https?://[^\s\p{{Z}}]+', '', 'g')"
    x = rf"regexp_replace({x}, '@[\p{{L}}\p{{N}}_]+', '', 'g')"
    x = rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}_$#''-]+', ' ', 'g')"
    return f"trim({x}, ' ')"


def norm(x: str) -> str:
    return f"trim(lower({x}), '$#')"


def tenths(p: str = "") -> str:
    return f"({p}likes * 10 + {p}retweets * 5 + {p}replies * 3)"


def display(term_type: str, key: str) -> str:
    word = "CASE WHEN w[1] = 'ß' THEN 'Ss' ELSE upper(w[1]) END || lower(substring(w, 2))"
    title = f"array_to_string(list_transform(string_split({key}, ' '), lambda w: {word}), ' ')"
    return (
        f"CASE WHEN {term_type} = 'cashtag' THEN '$' || {key} "
        f"WHEN {term_type} = 'hashtag' THEN '#' || {key} "
        f"WHEN starts_with({key}, '$') OR starts_with({key}, '#') THEN {key} ELSE {title} END"
    )


BEST = (
    "composite_score DESC, CASE term_type WHEN 'cashtag' THEN 0 WHEN 'hashtag' THEN 1 ELSE 2 END, key"
)

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    name: ((), testdata.duckdb_sql(name)) for name in testdata.SQL
}
CTES |= {
    "facts": (
        ("posts",),
        f"""SELECT id, username, created_at, text, hashtags, {tenths()} AS tenths,
                   len({cashtags('text')}) > 0 AS has_cashtag, {has_context('text')} AS has_context
            FROM posts WHERE NOT is_retweet""",
    ),
    "cashtag_mentions": (
        ("facts",),
        f"""SELECT 'cashtag' AS term_type, key, id, username, created_at, tenths, has_cashtag, has_context
            FROM (SELECT *, unnest({cashtags('text')}) AS key FROM facts) t
            WHERE NOT {noise('lower(key)')}""",
    ),
    "hashtag_mentions": (
        ("facts",),
        f"""SELECT 'hashtag' AS term_type, key, id, username, created_at, tenths, has_cashtag, has_context
            FROM (SELECT *, trim(lower(unnest(hashtags)), '#') AS key FROM facts) t
            WHERE length(key) BETWEEN 3 AND 25 AND NOT {noise('key')}""",
    ),
    "words": (
        ("facts",),
        f"""SELECT id, pos, w, regexp_matches(w, '{NOISE_INSIDE}') OR NOT regexp_matches(w, '[\\p{{L}}\\p{{N}}]') AS bad,
                   w IN ({STOPS}) AS stop
            FROM (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
                  FROM (SELECT id, string_split(lower({clean('text')}), ' ') AS ws FROM facts) c) u""",
    ),
    "runs": (
        ("words",),
        """SELECT *, lead(w, 1) OVER o AS w2, lead(bad, 1) OVER o AS bad2, lead(stop, 1) OVER o AS stop2,
                  lead(w, 2) OVER o AS w3, lead(bad, 2) OVER o AS bad3, lead(stop, 2) OVER o AS stop3
           FROM words WINDOW o AS (PARTITION BY id ORDER BY pos)""",
    ),
    "post_terms": (
        ("runs",),
        f"""SELECT DISTINCT id, key FROM (
              SELECT id, w AS key FROM runs
              WHERE NOT bad AND length(w) >= 3 AND NOT {noise('w')}
              UNION ALL
              SELECT id, w || ' ' || w2 FROM runs
              WHERE NOT bad AND NOT stop AND NOT bad2 AND NOT stop2
              UNION ALL
              SELECT id, w || ' ' || w2 || ' ' || w3 FROM runs
              WHERE NOT bad AND NOT stop AND NOT bad2 AND NOT bad3 AND NOT stop3) g
            WHERE NOT regexp_matches(key, '{NOISE_PHRASES}')""",
    ),
    "ngram_mentions": (
        ("facts", "post_terms"),
        """SELECT 'ngram' AS term_type, key, id, username, created_at, tenths, has_cashtag, has_context
           FROM post_terms JOIN facts USING (id)""",
    ),
    "mentions": (
        ("cashtag_mentions", "hashtag_mentions", "ngram_mentions"),
        """SELECT * FROM cashtag_mentions UNION ALL SELECT * FROM hashtag_mentions
           UNION ALL SELECT * FROM ngram_mentions""",
    ),
    "tag_mentions": (
        ("cashtag_mentions", "hashtag_mentions"),
        "SELECT * FROM cashtag_mentions UNION ALL SELECT * FROM hashtag_mentions",
    ),
}


def stats_sql(source: str) -> str:
    return f"""SELECT term_type, key, count(*) AS mention_count, count(DISTINCT username) AS unique_authors,
                 sum(tenths) / 10.0 AS total_engagement, sum(tenths) / 10.0 / count(*) AS avg_engagement,
                 min(created_at) AS first_seen, max(created_at) AS last_seen,
                 count(*) FILTER (term_type = 'cashtag' OR has_context) AS financial_context_count,
                 count(*) FILTER (term_type <> 'cashtag' AND has_cashtag) AS cashtag_cooccurrence_count
               FROM {source} GROUP BY ALL"""


def scored_sql(source: str) -> str:
    return f"""SELECT *, ((mention_count * 0.2 + velocity_score * 0.8)
                 * CASE WHEN financial_context_ratio < 0.4 THEN 0.01 + financial_context_ratio * 0.5
                        WHEN financial_context_ratio < 0.7 THEN 0.2 + financial_context_ratio * 0.85
                        ELSE 0.8 + financial_context_ratio * 0.7 END)
                 * (1.0 + cashtag_cooccurrence_ratio * 0.5) AS composite_score
               FROM (SELECT *, {display('term_type', 'key')} AS term,
                       financial_context_count::DOUBLE / mention_count AS financial_context_ratio,
                       cashtag_cooccurrence_count::DOUBLE / mention_count AS cashtag_cooccurrence_ratio,
                       total_engagement * (1 + unique_authors::DOUBLE / mention_count * 2) AS velocity_score
                     FROM {source}) s"""


QUALITY = """(unique_authors >= 10 AND financial_context_ratio >= 0.65
  AND (term_type = 'cashtag' OR cashtag_cooccurrence_ratio >= 0.1
       OR (financial_context_ratio >= 0.95 AND total_engagement > 20000)))"""

CTES |= {
    "stats": (("mentions",), stats_sql("mentions")),
    "supported": (("stats",), "SELECT * FROM stats WHERE mention_count >= 3 AND unique_authors >= 2"),
    "scored": (("supported",), scored_sql("supported")),
    "unique_trends": (
        ("scored",),
        f"""SELECT * EXCLUDE (rn) FROM (
              SELECT *, row_number() OVER (PARTITION BY {norm('term')} ORDER BY {BEST}) AS rn FROM scored) u
            WHERE rn = 1""",
    ),
    "candidates": (
        ("unique_trends",),
        f"""SELECT *, row_number() OVER (ORDER BY {BEST}) AS rank, {QUALITY} AS qualified
            FROM unique_trends ORDER BY {BEST} LIMIT 10""",
    ),
}


def with_ctes(names: tuple[str, ...] | list[str], body: str, **extra: str) -> str:
    """The body under the named building blocks and everything they need.

    Shared blocks are materialized: several of them are used more than once.
    """
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for needed in CTES[name][0]:
            add(needed)
        done.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in done]
    parts += [f"{n} AS ({sql})" for n, sql in extra.items()]
    return f"WITH {', '.join(parts)}\n{body}"
