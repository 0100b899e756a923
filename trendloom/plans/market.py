"""Queries over bars, quotes, symbols and claims."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from trendloom.functions import constants
from trendloom.operators import market, mentions
from trendloom.plans import oracle as o
from trendloom.plans import testdata as td
from trendloom.plans.registry import query

AS_OF = "DATE '2000-06-30'"
FETCHED = dt.datetime(2000, 6, 30, 18, 0)
# The moment the quote log is asked at.
LOG_AS_OF = dt.datetime(2000, 6, 30, 12, 30)

_ETFS = o.quoted(sorted({s for _, s in constants.SECTOR_SYMBOLS}))
_CATEGORY = f"""CASE WHEN ends_with(symbol, '=F') THEN 'commodity' WHEN ends_with(symbol, '-USD') THEN 'crypto'
  WHEN starts_with(symbol, '^') THEN 'index' WHEN symbol IN ({_ETFS}) THEN 'etf' ELSE 'stock' END"""
_QUOTES = {
    "month": f"""SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back,
        count(*) OVER (PARTITION BY symbol) AS n FROM bars
      WHERE date > {AS_OF} - INTERVAL 1 MONTH AND date <= {AS_OF}""",
    "year_range": f"""SELECT symbol, max(close) AS high_52w, min(close) AS low_52w FROM bars
      WHERE date > {AS_OF} - 365 AND date <= {AS_OF} GROUP BY 1""",
    "basis": """SELECT symbol, max(close) FILTER (back = 1) AS price, max(close) FILTER (back = 2) AS previous,
        max(close) FILTER (back = CASE WHEN n >= 6 THEN 6 ELSE n END) AS week_base,
        max(volume) FILTER (back = 1) AS volume, CAST(floor(avg(volume) FILTER (back <= 10)) AS BIGINT) AS avg_volume, max(n) AS n
      FROM month GROUP BY 1""",
    "quotes": f"""SELECT symbol, symbol AS name, price AS current_price,
        CASE WHEN n >= 2 THEN price - previous ELSE 0 END AS price_change_1d,
        CASE WHEN n >= 2 THEN (price - previous) / previous * 100 ELSE 0 END AS price_change_1d_pct,
        CASE WHEN n >= 2 THEN (price - week_base) / week_base * 100 END AS price_change_5d_pct,
        volume, avg_volume, high_52w, low_52w, TIMESTAMP '2000-06-30 18:00:00' AS fetched_at, {_CATEGORY} AS category
      FROM basis JOIN year_range USING (symbol)""",
    "flagged": """SELECT *, high_52w > 0 AND current_price >= high_52w * 0.95 AS is_near_52w_high,
        low_52w > 0 AND current_price <= low_52w * 1.05 AS is_near_52w_low,
        avg_volume > 0 AND volume > avg_volume * 2 AS is_unusual_volume,
        CASE WHEN avg_volume > 0 THEN volume / avg_volume ELSE 0 END AS volume_ratio FROM quotes""",
    "noted": """SELECT *, coalesce(nullif(concat_ws(', ', CASE WHEN is_near_52w_high THEN 'Near 52w High' END,
        CASE WHEN is_near_52w_low THEN 'Near 52w Low' END, CASE WHEN is_unusual_volume THEN 'High Volume' END), ''), '-') AS notes
      FROM flagged""",
}


def month_quotes(spark, sf):
    return market.quotes(td.derived(spark, sf, "bars"), td.MARKET_AS_OF, FETCHED)


@query("market_quotes", o.with_ctes(["bars"], "SELECT * FROM quotes", **_QUOTES))
def _(spark, sf):
    return month_quotes(spark, sf).drop("market_cap")


@query(
    "month_bars",
    o.with_ctes(
        ["bars"],
        f"SELECT * FROM bars WHERE date > {AS_OF} - INTERVAL 1 MONTH AND date <= {AS_OF}",
    ),
)
def _(spark, sf):
    return market.month_bars(td.derived(spark, sf, "bars"), td.MARKET_AS_OF)


@query(
    "bar_indicators",
    o.with_ctes(
        ["bars"],
        """SELECT symbol, date, close, volume, coalesce(close - lag(close) OVER w, 0) AS change_1d,
             coalesce((close - lag(close) OVER w) / lag(close) OVER w * 100, 0) AS change_1d_pct,
             (close - lag(close, 5) OVER w) / lag(close, 5) OVER w * 100 AS change_5d_pct,
             max(close) OVER y AS high_52w, min(close) OVER y AS low_52w,
             CAST(floor(avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) AS BIGINT) AS avg_volume
           FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date),
             y AS (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 364 DAYS PRECEDING AND CURRENT ROW)""",
    ),
)
def _(spark, sf):
    return market.bar_indicators(td.derived(spark, sf, "bars"))


@query(
    "latest_bars",
    o.with_ctes(
        ["bars"],
        """SELECT symbol, date, close, volume FROM (
             SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars) b WHERE rn = 1""",
    ),
)
def _(spark, sf):
    return market.latest_bars(td.derived(spark, sf, "bars"))


@query(
    "quote_flags",
    o.with_ctes(
        ["bars"],
        "SELECT symbol, category, is_near_52w_high, is_near_52w_low, is_unusual_volume, volume_ratio, notes FROM noted",
        **_QUOTES,
    ),
)
def _(spark, sf):
    return market.with_flags(month_quotes(spark, sf)).select(
        "symbol", "category", "is_near_52w_high", "is_near_52w_low", "is_unusual_volume",
        "volume_ratio", "notes",
    )


@query(
    "quotes_by_category",
    o.with_ctes(
        ["bars"],
        """SELECT category, count(*) AS n_symbols, max(price_change_1d_pct) AS best_1d_pct,
             min(price_change_1d_pct) AS worst_1d_pct FROM quotes GROUP BY 1""",
        **_QUOTES,
    ),
)
def _(spark, sf):
    return market.category_summary(month_quotes(spark, sf))


def _family(name: str, table, whole_word: bool) -> str:
    values = ", ".join(f"({i}, '{k}', '{s}')" for i, (k, s) in enumerate(table))
    hit = f"list_contains(string_split_regex(trim(lower(term)), '\\s+'), k)" if whole_word else "contains(trim(lower(term)), k)"
    return f"""SELECT term, symbol FROM (SELECT term, s AS symbol,
        row_number() OVER (PARTITION BY term ORDER BY i) AS rn
      FROM plain_terms JOIN (VALUES {values}) AS {name}(i, k, s) ON {hit}) r WHERE rn = 1"""


def _symbol_ctes(terms: str) -> dict[str, str]:
    return {
        "named_terms": terms,
        "plain_terms": r"SELECT DISTINCT term FROM named_terms WHERE NOT regexp_matches(term, '^\$[A-Za-z]{1,5}$')",
        "symbols": r"SELECT DISTINCT term, upper(substring(term, 2)) AS symbol FROM named_terms WHERE regexp_matches(term, '^\$[A-Za-z]{1,5}$')"
        + f""" UNION {_family('com', constants.COMMODITY_SYMBOLS, False)}
            UNION {_family('cry', constants.CRYPTO_SYMBOLS, True)}
            UNION {_family('ind', constants.INDEX_SYMBOLS, False)}
            UNION {_family('sec', constants.SECTOR_SYMBOLS, False)}""",
    }


_SUPPORTED_TERMS = f"SELECT DISTINCT {o.display('term_type', 'key')} AS term FROM supported"


def supported_terms(spark, sf):
    stats = mentions.post_stats(td.derived(spark, sf, "posts"))
    return mentions.with_scores(mentions.supported(stats)).select("term").distinct()


@query(
    "trend_symbols",
    o.with_ctes(["supported"], "SELECT term, symbol FROM symbols", **_symbol_ctes(_SUPPORTED_TERMS)),
)
def _(spark, sf):
    return market.trend_symbols(supported_terms(spark, sf))


@query(
    "digest_trend_symbols",
    o.with_ctes(
        ["digests"],
        "SELECT term, symbol FROM symbols",
        **_symbol_ctes("SELECT DISTINCT unnest(trends) AS term FROM digests"),
    ),
)
def _(spark, sf):
    terms = td.derived(spark, sf, "digests").select(F.explode("trends").alias("term")).distinct()
    return market.trend_symbols(terms)


# Plain upper-case names that the keyword tables do not know stand for themselves.
@query(
    "requested_symbols",
    """SELECT DISTINCT term AS symbol FROM (
          SELECT upper(substring(p_type, 1, 3)) || CAST(p_size % 7 AS VARCHAR) AS term FROM part) b
        WHERE length(term) <= 5""",
)
def _(spark, sf):
    terms = td.table(spark, sf, "part").select(
        F.concat(F.upper(F.substring("p_type", 1, 3)), (F.col("p_size") % 7).cast("string")).alias("term")
    )
    return market.requested_symbols(terms.distinct())


# Trends of the digests name symbols, so the upper-case names beside them do not stand in.
@query(
    "requested_symbols_named",
    o.with_ctes(
        ["digests"],
        """SELECT DISTINCT symbol FROM symbols
           UNION ALL SELECT DISTINCT term FROM named_terms
           WHERE length(term) <= 5 AND term = upper(term) AND term <> lower(term) AND NOT EXISTS (SELECT 1 FROM symbols)""",
        **_symbol_ctes(
            """SELECT DISTINCT unnest(trends) AS term FROM digests
               UNION SELECT upper(substring(p_type, 1, 3)) || CAST(p_size % 7 AS VARCHAR) FROM part"""
        ),
    ),
)
def _(spark, sf):
    names = td.table(spark, sf, "part").select(
        F.concat(F.upper(F.substring("p_type", 1, 3)), (F.col("p_size") % 7).cast("string")).alias("term")
    )
    trends = td.derived(spark, sf, "digests").select(F.explode("trends").alias("term"))
    return market.requested_symbols(trends.unionByName(names).distinct())


@query(
    "symbols_with_common",
    o.with_ctes(
        ["digests"],
        f"SELECT symbol FROM symbols UNION SELECT unnest([{o.quoted(constants.COMMON_SYMBOLS)}])",
        **_symbol_ctes("SELECT DISTINCT unnest(trends) AS term FROM digests"),
    ),
)
def _(spark, sf):
    terms = td.derived(spark, sf, "digests").select(F.explode("trends").alias("term"))
    return market.with_common_symbols(market.trend_symbols(terms))


_FRESH = """SELECT symbol, current_price, fetched_at FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fetched_at DESC, current_price DESC) AS rn FROM quote_log
    WHERE fetched_at > TIMESTAMP '2000-06-30 12:30:00' - INTERVAL 240 MINUTES AND fetched_at <= TIMESTAMP '2000-06-30 12:30:00') q
  WHERE rn = 1"""


@query("fresh_quotes", o.with_ctes(["quote_log"], _FRESH))
def _(spark, sf):
    log = td.derived(spark, sf, "quote_log")
    return market.fresh_quotes(log, LOG_AS_OF, ttl_minutes=240)


@query(
    "stale_symbols",
    o.with_ctes(
        ["quote_log"],
        "SELECT DISTINCT symbol FROM quote_log WHERE symbol NOT IN (SELECT symbol FROM fresh)",
        fresh=_FRESH,
    ),
)
def _(spark, sf):
    log = td.derived(spark, sf, "quote_log")
    return market.stale_symbols(log, market.fresh_quotes(log, LOG_AS_OF, ttl_minutes=240))


@query(
    "quotes_at_mention",
    o.with_ctes(
        ["posts", "price_log"],
        """SELECT n.id, n.created_at, n.symbol, q.current_price, q.fetched_at FROM named n LEFT JOIN LATERAL (
             SELECT current_price, fetched_at FROM price_log q WHERE q.symbol = n.symbol
               AND q.fetched_at <= n.created_at AND q.fetched_at > n.created_at - INTERVAL 60 MINUTES
             ORDER BY fetched_at DESC, quote_id DESC LIMIT 1) q ON true""",
        named=f"""SELECT DISTINCT id, created_at, unnest({o.cashtags('text')}) AS symbol FROM posts WHERE NOT is_retweet""",
    ),
)
def _(spark, sf):
    return market.quotes_at_mention(
        td.derived(spark, sf, "posts"), td.derived(spark, sf, "price_log"), ttl_minutes=60
    )


@query(
    "trend_quotes",
    o.with_ctes(
        ["digests", "bars"],
        """SELECT term, symbol, current_price, price_change_1d_pct, price_change_5d_pct, category, notes
           FROM symbols JOIN noted USING (symbol)""",
        **_symbol_ctes("SELECT DISTINCT unnest(trends) AS term FROM digests"),
        **_QUOTES,
    ),
)
def _(spark, sf):
    terms = td.derived(spark, sf, "digests").select(F.explode("trends").alias("term")).distinct()
    return market.trend_quotes(terms, month_quotes(spark, sf)).select(
        "term", "symbol", "current_price", "price_change_1d_pct", "price_change_5d_pct",
        "category", "notes",
    )


_UP = "up|gain|gains|gained|rally|rallied|soaring|jumped"
_DOWN = "down|drop|dropped|fell|crash|crashing|crashed|plunged"


_NUMBER = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"
_PHRASES = r"(?:huge|massive|heavy|record) volume|52w high|52-week high|all-time high"
_STATED = rf"(?:(?:^|[^\p{{L}}\p{{N}}_])(?:{_UP}|{_DOWN})\s+{_NUMBER}\s?%|{_PHRASES})"


# Tickers become marks; what follows a mark up to the next is searched for claims, in order.
@query(
    "claims_checked",
    o.with_ctes(
        ["posts", "bars"],
        rf"""SELECT id, claim_number, symbol, kind, claimed_pct, price_change_1d_pct AS actual_pct,
             CASE WHEN price_change_1d_pct IS NULL THEN 'UNVERIFIED'
                  WHEN kind = 'volume' THEN CASE WHEN is_unusual_volume THEN 'VERIFIED' ELSE 'EXAGGERATED' END
                  WHEN kind = 'high' THEN CASE WHEN is_near_52w_high THEN 'VERIFIED' ELSE 'EXAGGERATED' END
                  WHEN sign(claimed_pct) * sign(price_change_1d_pct) < 0 THEN 'FALSE'
                  WHEN abs(claimed_pct) > abs(price_change_1d_pct) + 2.0 THEN 'EXAGGERATED' ELSE 'VERIFIED' END AS verdict
           FROM (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY part, place) - 1 AS INT) AS claim_number,
                   coalesce(nullif(symbol, ''), first_symbol) AS symbol,
                   CASE WHEN ends_with(c, '%') THEN 'move' WHEN contains(c, 'volume') THEN 'volume' ELSE 'high' END AS kind,
                   CASE WHEN regexp_matches(c, '^[^a-z0-9]*(?:{_DOWN})\s') THEN -1 ELSE 1 END
                     * CAST(replace(nullif(regexp_extract(c, '({_NUMBER})\s?%$', 1), ''), ',', '') AS DOUBLE) AS claimed_pct
                 FROM (SELECT *, unnest(found) AS c, generate_subscripts(found, 1) AS place FROM searched) u) s
           LEFT JOIN flagged USING (symbol)""",
        marked=rf"""SELECT id, string_split(regexp_replace(regexp_replace(text, '\$', ' $', 'g'),
              '\$([A-Za-z]{{1,5}})([^\p{{L}}\p{{N}}_]|$)', chr(2) || '\1' || chr(3) || '\2', 'g'), chr(2)) AS parts,
            {o.cashtags('text')}[1] AS first_symbol
          FROM posts WHERE NOT is_retweet AND len({o.cashtags('text')}) > 0""",
        parted="SELECT id, first_symbol, generate_subscripts(parts, 1) AS part, unnest(parts) AS p FROM marked",
        searched=f"""SELECT id, part, first_symbol, CASE WHEN part > 1 THEN upper(split_part(p, chr(3), 1)) ELSE '' END AS symbol,
            regexp_extract_all(lower(CASE WHEN part > 1 THEN split_part(p, chr(3), 2) ELSE p END), '{_STATED}') AS found FROM parted""",
        **_QUOTES,
    ),
)
def _(spark, sf):
    claims = market.claims(td.derived(spark, sf, "posts"))
    return market.checked_claims(claims, month_quotes(spark, sf))
