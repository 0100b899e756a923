"""From posts to term mentions, and from mentions to trend rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions import ngrams, scoring, text
from trendloom.functions.text import DEFAULT_RULES, TermRules
from trendloom.operators import dealt
from trendloom.session import GATHER_BYTES, broadcast_if, gathered, tasks_for

CASHTAG, HASHTAG, NGRAM = "cashtag", "hashtag", "ngram"
ALL_TYPES = (CASHTAG, HASHTAG, NGRAM)
_FACTS = ("id", "username", "created_at", "engagement_tenths", "has_cashtag", "has_context")


def post_facts(posts: DataFrame, rules: TermRules = DEFAULT_RULES) -> DataFrame:
    """Posts without retweets, with engagement, cashtag and context facts."""
    return posts.where(~F.col("is_retweet")).select(
        "id",
        "username",
        "created_at",
        "text",
        "hashtags",
        scoring.engagement_tenths(F.col("likes"), F.col("retweets"), F.col("replies")).alias(
            "engagement_tenths"
        ),
        text.has_cashtag(F.col("text")).alias("has_cashtag"),
        text.has_context(F.col("text"), rules).alias("has_context"),
    )


def with_term_words(posts: DataFrame, rules: TermRules = DEFAULT_RULES) -> DataFrame:
    """Add the term line of each text and its words, as columns so that each is computed once."""
    return (
        posts.withColumn("line", text.term_line(F.col("text"), rules))
        .withColumn("inner", text.inner_words(F.col("line")))
        .withColumn("outer", text.outer_words(F.col("inner"), rules))
    )


def mentions(
    posts: DataFrame,
    term_types: tuple[str, ...] = ALL_TYPES,
    rules: TermRules = DEFAULT_RULES,
    only: dict[str, list[str]] | None = None,
) -> DataFrame:
    """One narrow row per mention of a term: all families from one scan and one explode.

    Cashtags and hashtags count once per occurrence, n-grams once per post; a post without text or
    without a list of hashtags keeps its other terms. ``only`` restricts the rows to a short list of
    keys per family, before they are exploded.
    """
    if only is not None:
        term_types = tuple(t for t in term_types if only.get(t))
    facts = post_facts(posts, rules)
    keys = {
        CASHTAG: lambda: text.cashtag_keys(F.col("text"), rules),
        HASHTAG: lambda: text.hashtag_keys(F.col("hashtags"), rules),
        NGRAM: lambda: ngrams.text_keys(F.col("text"), rules),
    }
    wanted = only or {}
    for t in term_types:
        none = F.array().cast("array<string>")
        facts = facts.withColumn(f"{t}_keys", F.coalesce(_among(keys[t](), wanted.get(t)), none))
    # One array of plain keys; the place of a key tells its family, so no struct is made for each.
    lists = [F.col(f"{t}_keys") for t in term_types]
    rows = facts.select(*_FACTS, *(F.size(k).alias(f"{t}_size") for t, k in zip(term_types, lists)), F.posexplode(F.concat(*lists)).alias("place", "key"))
    family, before = F.when(F.lit(False), F.lit("")), F.lit(0)
    for t in term_types[:-1]:
        before = before + F.col(f"{t}_size")
        family = family.when(F.col("place") < before, F.lit(t))
    return rows.select(family.otherwise(F.lit(term_types[-1])).alias("term_type"), "key", *_FACTS)


def _among(keys: Column, wanted: list[str] | None) -> Column:
    return F.filter(keys, lambda k: k.isin(*wanted)) if wanted else keys


#: Rows of mentions that are grouped at once in a task.
FOLD_ROWS = 2_000_000
#: Terms that a task gathers before it deals them out, and the most rows of terms that it hands over at once.
BLOCK_TERMS, ROW_TERMS = 1_000_000, 50_000

_ROW = ("key", "username", "created_at", "marks")


def _counting(least: tuple[int, int], fold: int):
    """A function that groups the rows of a task; it stands on its own, so that executors need no package for it.

    Spark would combine by (term, author) and by term twice each, in four tables of nearly as many groups as rows;
    here each group is made once, in columns, from so many rows at a time, and their parts are put together at the end.
    Keys and authors are numbered first and grouped as numbers. ``marks`` holds, from the lowest bit,
    both flags, whether the engagement is known, the family in two bits, and the engagement.
    """
    families, row, names = ALL_TYPES, _ROW, _COUNTERS

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        sums = [(c, "sum") for c in ("tenths", "financial_context_count", "cashtag_cooccurrence_count", "mention_count")]
        times = [("first_seen", "min"), ("last_seen", "max")]

        def plain(batch):
            return pa.Table.from_arrays([batch.column(c) for c in row], names=row)

        def unpacked(some):
            table = pa.concat_tables(some)
            marks = table.column("marks")
            number = lambda n: pa.scalar(n, pa.int64())
            context, company, known = (pc.bit_wise_and(pc.shift_right(marks, number(n)), number(1)) for n in (0, 1, 2))
            family = pc.bit_wise_and(pc.shift_right(marks, number(3)), number(3))
            seen = table.column("created_at")
            made = {
                "family": family, "key": table.column("key"), "username": table.column("username"),
                "tenths": pc.if_else(pc.equal(known, 1), pc.shift_right(marks, number(5)), None),
                "financial_context_count": context, "cashtag_cooccurrence_count": company,
                "mention_count": pa.chunked_array([pa.repeat(pa.scalar(1, pa.int64()), len(table))]),
                "first_seen": seen, "last_seen": seen,
            }
            return by_author(pa.table(made))

        def grouped(table, *by, more=()):
            made = table.group_by(list(by), use_threads=False).aggregate([*sums, *times, *more])
            return made.rename_columns({f"{c}_{how}": c for c, how in (*sums, *times)})

        def by_author(table):
            """Rows of equal term and author as one, the numbers of both, and what the numbers stand for."""
            key, author = (table.column(c).combine_chunks().dictionary_encode() for c in ("key", "username"))
            term = pc.add(pc.multiply(key.indices.cast(pa.int64()), len(families)), table.column("family"))
            numbered = table.drop_columns(["family", "key", "username"]).append_column("term", term).append_column("author", author.indices)
            return grouped(numbered, "term", "author"), key.dictionary, author.dictionary

        def named(made, keys):
            number = pc.divide(made.column("term"), len(families))
            family = pc.subtract(made.column("term"), pc.multiply(number, len(families)))
            return made.append_column("key", keys.take(number.combine_chunks())).append_column("family", family)

        def spelled(made, keys, authors):
            return named(made, keys).append_column("username", authors.take(made.column("author").combine_chunks())).drop_columns(["term", "author"])

        parts, waiting, n = [], [], 0
        for batch in batches:
            waiting.append(plain(batch))
            n += len(waiting[-1])
            if n >= fold:
                parts.append(spelled(*unpacked(waiting)))
                waiting, n = [], 0
        if not parts and not n:
            return
        if n:
            parts.append(unpacked(waiting) if not parts else spelled(*unpacked(waiting)))
        del waiting
        whole, keys, _ = parts.pop() if isinstance(parts[0], tuple) else by_author(pa.concat_tables(p.select(parts[0].column_names) for p in parts))
        del parts
        made = grouped(whole, "term", more=[("author", "count")]).rename_columns({"author_count": "unique_authors"})
        made = made.filter(pc.and_(pc.greater_equal(made["mention_count"], least[0]), pc.greater_equal(made["unique_authors"], least[1])))
        made = named(made, keys)
        term_type = pa.array(families).take(made.column("family").combine_chunks())
        yield from made.append_column("term_type", term_type).select(names).to_batches(max_chunksize=50_000)

    return run


_COUNTERS = ["term_type", "key", "mention_count", "unique_authors", "tenths", "first_seen", "last_seen", "financial_context_count", "cashtag_cooccurrence_count"]


def _counters(posts: DataFrame) -> str:
    time = posts.schema["created_at"].dataType.simpleString()
    kinds = {"term_type": "string", "key": "string", "first_seen": time, "last_seen": time}
    return ", ".join(f"{c} {kinds.get(c, 'long')}" for c in _COUNTERS)


def _marks(family: Column | int, context: Column, company: Column) -> Column:
    tenths = F.col("engagement_tenths").cast("long")
    flags = context.cast("long") + company.cast("long") * 2 + tenths.isNotNull().cast("long") * 4
    return (F.coalesce(tenths, F.lit(0)) * 32 + family * 8 + flags).cast("long")


def _counted(rows: DataFrame, tasks: int, least: tuple[int, int] = (0, 0)) -> DataFrame:
    """Counters per term, in so many tasks, each of which has all rows of its keys; terms with fewer mentions or authors stay there."""
    family = F.lit(len(ALL_TYPES) - 1)
    for n, t in enumerate(ALL_TYPES[:-1]):
        family = F.when(F.col("term_type") == t, n).otherwise(family)
    marks = _marks(family, F.col("in_context"), F.col("in_company"))
    narrow = gathered(rows.select("key", "username", "created_at", marks.alias("marks")), tasks, "key")
    return narrow.mapInArrow(_counting(least, FOLD_ROWS), _counters(rows))


def term_blocks(
    posts: DataFrame, tasks: int, groups: int, term_types: tuple[str, ...], rules: TermRules, facts: dict[str, Column], trimmed: bool = False
) -> DataFrame:
    """Terms of posts without retweets, as blocks in so many tasks, each of which has all mentions of its terms.

    ``facts`` are those that blocks keep of each post, besides ``username`` if that is among them: times first, and whole numbers.
    """
    keys = {
        CASHTAG: lambda: text.cashtag_keys(F.col("text"), rules),
        HASHTAG: lambda: text.hashtag_keys(F.col("hashtags"), rules),
        NGRAM: lambda: ngrams.term_lines(F.col("text")),
    }
    terms = {t: keys[t]() for t in term_types}
    if trimmed:
        terms = {t: k if t == NGRAM else F.transform(k, text.normalized_key) for t, k in terms.items()}
    narrow = post_facts(posts, rules).select(*(c.alias(n) for n, c in facts.items()), *(k.alias(t) for t, k in terms.items()))
    lists = {t: ALL_TYPES.index(t) for t in term_types if t != NGRAM}
    names = tuple(n for n in facts if n != "username")
    places = ngrams.places_of_lines(rules)
    made = dealt.dealing(tasks, groups, lists, NGRAM if NGRAM in term_types else None, places, BLOCK_TERMS, names, trimmed)
    blocks = narrow.mapInArrow(made, "task int, block binary")
    return blocks.repartitionById(tasks, "task").select("block")


def tasks_and_groups(posts_tasks: int, cores: int) -> tuple[int, int]:
    """So many groupings as tasks and as groupings of a task: blocks for fewer tasks share more of their words and posts."""
    tasks = max(cores, -(-posts_tasks // dealt.GROUPINGS))
    return tasks, -(-posts_tasks // tasks)


def post_marks() -> Column:
    """What blocks keep of a post of ``post_facts`` besides its author and time."""
    tenths = F.col("engagement_tenths").cast("long")
    flags = [F.coalesce(F.col(c), F.lit(False)).cast("long") for c in ("has_context", "has_cashtag")]
    return F.coalesce(tenths, F.lit(0)) * 8 + tenths.isNotNull().cast("long") * 4 + flags[1] * 2 + flags[0]


def _counted_posts(posts: DataFrame, tasks: int, term_types: tuple[str, ...], rules: TermRules, least: tuple[int, int]) -> DataFrame:
    """As ``_counted`` of the mentions of the posts, which are dealt to tasks in blocks and never are a row each."""
    spark = posts.sparkSession
    tasks, groups = tasks_and_groups(tasks, spark.sparkContext.defaultParallelism)
    facts = {"username": F.col("username"), "created_at": F.col("created_at"), "marks": post_marks()}
    zone = None if posts.schema["created_at"].dataType.simpleString() == "timestamp_ntz" else spark.conf.get("spark.sql.session.timeZone")
    blocks = term_blocks(posts, tasks, groups, term_types, rules, facts)
    return blocks.mapInArrow(dealt.counting(groups, least, FOLD_ROWS, ROW_TERMS, ALL_TYPES, _COUNTERS, zone), _counters(posts))


def post_stats(
    posts: DataFrame,
    term_types: tuple[str, ...] = ALL_TYPES,
    rules: TermRules = DEFAULT_RULES,
    exact_authors: bool = True,
    least: tuple[int, int] = (0, 0),
) -> DataFrame:
    """``term_stats`` of the mentions of the posts; stored posts are dealt to tasks by term in blocks."""
    tasks = tasks_for(posts, GATHER_BYTES)
    if not tasks:
        return term_stats(mentions(posts, term_types, rules), exact_authors, least)
    return _with_engagement(_counted_posts(posts, tasks, term_types, rules, least))


def _with_engagement(stats: DataFrame) -> DataFrame:
    return (
        stats.withColumn("total_engagement", F.col("tenths") / 10.0)
        .withColumn("avg_engagement", scoring.ratio(F.col("total_engagement"), F.col("mention_count")))
        .drop("tenths")
    )


def term_stats(mention_rows: DataFrame, exact_authors: bool = True, least: tuple[int, int] = (0, 0)) -> DataFrame:
    """Counters per term, of those with at least so many mentions and authors.

    Most terms are met once or twice, so combining them before the shuffle would cost more than it saves:
    narrow rows are shuffled once, to tasks as many as the stored posts ask for, whose groups stay in memory.
    Where that number is not known, Spark combines by (term, author) on the map side and shuffles by that
    pair first. Approximate author counts (within about 5 percent) save counting by author there.
    """
    in_company = (F.col("term_type") != CASHTAG) & F.col("has_cashtag")
    in_context = (F.col("term_type") == CASHTAG) | F.col("has_context")
    rows = mention_rows.select(
        "term_type", "key", "username", "engagement_tenths", "created_at",
        F.coalesce(in_context, F.lit(False)).alias("in_context"), F.coalesce(in_company, F.lit(False)).alias("in_company"),
    )
    tasks = tasks_for(mention_rows, GATHER_BYTES)
    if tasks:
        stats = _counted(rows, tasks, least)
    else:
        authors = F.countDistinct if exact_authors else F.approx_count_distinct
        stats = rows.groupBy("term_type", "key").agg(
            F.count(F.lit(1)).alias("mention_count"),
            authors("username").alias("unique_authors"),
            F.sum("engagement_tenths").alias("tenths"),
            F.min("created_at").alias("first_seen"),
            F.max("created_at").alias("last_seen"),
            F.count_if("in_context").alias("financial_context_count"),
            F.count_if("in_company").alias("cashtag_cooccurrence_count"),
        )
        stats = supported(stats, *least) if any(least) else stats
    return _with_engagement(stats)


def with_scores(stats: DataFrame) -> DataFrame:
    """Display term, ratios, scores and quality flag of each trend."""
    key = F.col("key")
    shown = (
        F.when(F.col("term_type") == CASHTAG, F.concat(F.lit("$"), key))
        .when(F.col("term_type") == HASHTAG, F.concat(F.lit("#"), key))
        .when(key.startswith("$") | key.startswith("#"), key)
        .otherwise(F.initcap(key))
    )
    n = F.col("mention_count")
    return (
        stats.withColumn("term", shown)
        .withColumn("financial_context_ratio", scoring.ratio(F.col("financial_context_count"), n))
        .withColumn(
            "cashtag_cooccurrence_ratio", scoring.ratio(F.col("cashtag_cooccurrence_count"), n)
        )
        .withColumn(
            "velocity_score",
            scoring.velocity_score(F.col("total_engagement"), F.col("unique_authors"), n),
        )
        .withColumn(
            "composite_score",
            scoring.composite_score(
                n,
                F.col("velocity_score"),
                F.col("financial_context_ratio"),
                F.col("cashtag_cooccurrence_ratio"),
            ),
        )
    )


def with_quality(trends: DataFrame, min_authors: int = 10, min_context: float = 0.65) -> DataFrame:
    return trends.withColumn(
        "qualified",
        scoring.passes_quality(
            F.col("term_type"),
            F.col("unique_authors"),
            F.col("financial_context_ratio"),
            F.col("cashtag_cooccurrence_ratio"),
            F.col("total_engagement"),
            min_authors,
            min_context,
        ),
    )


def supported(stats: DataFrame, min_mentions: int = 3, min_authors: int = 2) -> DataFrame:
    return stats.where(
        (F.col("mention_count") >= min_mentions) & (F.col("unique_authors") >= min_authors)
    )


def supported_stats(mention_rows: DataFrame, min_mentions: int = 3, min_authors: int = 2, exact_authors: bool = True) -> DataFrame:
    """Counters of the supported terms only: most terms are not, and never leave the task that counts them."""
    return term_stats(mention_rows, exact_authors, (min_mentions, min_authors))


def supported_post_stats(
    posts: DataFrame, term_types: tuple[str, ...] = ALL_TYPES, rules: TermRules = DEFAULT_RULES,
    min_mentions: int = 3, min_authors: int = 2, exact_authors: bool = True,
) -> DataFrame:
    """``supported_stats`` of the mentions of the posts."""
    return post_stats(posts, term_types, rules, exact_authors, (min_mentions, min_authors))


def first_posts(mention_rows: DataFrame, k: int = 3) -> DataFrame:
    """The first k mentioning posts of each term, oldest first.

    Narrow rows are gathered by term in tasks that sort them in memory; where their number is not known,
    the rank filter is applied per task before the shuffle, so a hot term sends k rows per task.
    """
    oldest = Window.partitionBy("term_type", "key").orderBy("created_at", "id")
    rows = gathered(mention_rows.select("term_type", "key", "created_at", "id"), tasks_for(mention_rows), "term_type", "key")
    return rows.withColumn("sample_rank", F.row_number().over(oldest)).where(F.col("sample_rank") <= k)


def first_post_samples(posts: DataFrame, k: int = 3, length: int = 200, rules: TermRules = DEFAULT_RULES) -> DataFrame:
    """``first_posts`` of all terms of the posts, with the beginnings of the texts of these.

    Terms of stored posts are dealt to tasks in blocks, ranked there, and dealt by post in blocks again to where the texts are.
    """
    originals = posts.select("id", F.substring("text", 1, length).alias("sample"))
    wanted = tasks_for(posts, GATHER_BYTES)
    time = posts.schema["created_at"].dataType.simpleString()
    if not wanted or posts.schema["id"].dataType.simpleString() != "bigint" or not time.startswith("timestamp"):
        first = first_posts(mentions(posts, rules=rules), k).select("term_type", "key", "sample_rank", "id")
        return gathered(first, tasks_for(posts), "id").join(originals, "id")
    tasks, groups = tasks_and_groups(wanted, posts.sparkSession.sparkContext.defaultParallelism)
    place = F.pmod(F.xxhash64("id"), F.lit(tasks))
    blocks = term_blocks(posts, tasks, groups, ALL_TYPES, rules, {"created_at": F.col("created_at"), "id": F.col("id"), "place": place})
    ranked = blocks.mapInArrow(dealt.first_posts(groups, tasks, k, BLOCK_TERMS), "task int, block binary")
    rows = originals.where("id IS NOT NULL").select(place.cast("int").alias("task"), F.lit(None).cast("binary").alias("block"), "id", "sample")
    both = rows.unionByName(ranked, allowMissingColumns=True).repartitionById(tasks, "task")
    schema = "id long, term_type string, key string, sample_rank int, sample string"
    return both.select("block", "id", "sample").mapInArrow(dealt.with_samples(ALL_TYPES, ROW_TERMS), schema)


def sample_texts(
    posts: DataFrame,
    mention_rows: DataFrame,
    k: int = 3,
    length: int = 200,
    n_terms: int | None = None,
) -> DataFrame:
    """First sample texts per term. Text joins the ranked ids only, never the mention rows.

    With a known number of terms there are at most k ids each, which can travel to the posts.
    """
    chosen = first_posts(mention_rows, k).select("term_type", "key", "sample_rank", "id")
    if n_terms is not None:
        chosen = broadcast_if(chosen, n_terms * k)
    originals = (
        posts.where(~F.col("is_retweet"))
        .select("id", F.substring("text", 1, length).alias("sample"))
    )
    return (
        originals.join(chosen, "id")
        .groupBy("term_type", "key")
        .agg(F.sort_array(F.collect_list(F.struct("sample_rank", "id", "sample"))).alias("s"))
        .select("term_type", "key", F.slice(F.col("s.sample"), 1, k).alias("sample_tweets"))
    )


def daily_activity(mention_rows: DataFrame) -> DataFrame:
    """Mentions and engagement per normalized key and day: the rows of trend_history."""
    return (
        mention_rows.groupBy(
            text.normalized_key(F.col("key")).alias("trend_term"),
            F.to_date("created_at").alias("run_date"),
        )
        .agg(
            F.count(F.lit(1)).alias("mention_count"),
            (F.sum("engagement_tenths") / 10.0).alias("engagement_score"),
        )
    )
