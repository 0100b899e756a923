"""Look-up of many phrases in posts by an inverted join on the rarest word of each phrase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.session import written


def phrase_key(col: Column) -> Column:
    """Words of a text, one blank apart, for phrase look-up: letters, digits, $, # and apostrophes inside words.

    Quotation marks around words and hyphens between them end words, so that a phrase is found in
    'quotes' and as a part of hyphen-joined words.
    """
    low = F.lower(col)
    unquoted = F.regexp_replace(low, r"(?<![\p{L}\p{N}_])'+|'+(?![\p{L}\p{N}_])", " ")
    unquoted = F.when(F.contains(low, F.lit("'")), unquoted).otherwise(low)
    return F.btrim(F.regexp_replace(unquoted, r"[^\p{L}\p{N}_$#'%&]+", " "))


def phrase_words(col: Column) -> Column:
    """The words of ``phrase_key``."""
    return F.split(phrase_key(col), " ")


def anchors(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrase, its rarest word (the first of equals), and the numbers of words before and behind it.

    ``words`` has one array ``_words`` per post, ``phrases`` a column ``phrase``. Only words of the
    phrases are counted. A phrase with a word that stands in no post is left out, as it is nowhere found.
    Outer explodes spare the filter on the array that Spark infers for others, which would split every text again.
    """
    parts = phrases.select("phrase").distinct().select("phrase", F.posexplode(F.split("phrase", " ")).alias("_at", "_word"))
    needed = parts.select("_word").distinct()
    met = words.select(F.explode_outer("_words").alias("_word")).groupBy("_word").agg(F.count("*").alias("_met"))
    counts = met.join(needed, "_word", "left_semi")
    rarest = parts.join(counts, "_word", "left").groupBy("phrase").agg(
        F.min(F.struct(F.coalesce("_met", F.lit(0)).alias("met"), F.col("_at").alias("before"), "_word")).alias("_a"),
        F.max("_at").alias("_last"),
    )
    found = rarest.where("_a.met > 0")
    return found.select("phrase", "_a._word", F.col("_a.before").alias("_before"), (F.col("_last") - F.col("_a.before")).alias("_behind"))


#: As many phrases as this need no count of their words: their anchors make but a bounded number of rows for each place.
FEW_PHRASES = 2000


def long_anchors(phrases: DataFrame) -> DataFrame:
    """As ``anchors``, with the longest word (the first of equals) for the rarest, so that no post is read."""
    parts = phrases.select("phrase").distinct().select("phrase", F.posexplode(F.split("phrase", " ")).alias("_at", "_word"))
    longest = parts.groupBy("phrase").agg(
        F.min(F.struct((-F.length("_word")).alias("size"), F.col("_at").alias("before"), "_word")).alias("_a"),
        F.max("_at").alias("_last"),
    )
    return longest.select("phrase", "_a._word", F.col("_a.before").alias("_before"), (F.col("_last") - F.col("_a.before")).alias("_behind"))


#: As many phrases as this are sought in each text one by one, which takes less than to lay out its words.
LISTED_PHRASES = 50


def _listed_hits(posts: DataFrame, phrases: DataFrame, narrow: list[str]) -> DataFrame:
    """Posts with each phrase that stands in their words, without a row for each word. A null phrase or text matches nothing."""
    lines = posts.select(*narrow, F.concat(F.lit(" "), phrase_key(F.col("text")), F.lit(" ")).alias("_line"))
    sought = F.broadcast(phrases.select("phrase").distinct())
    # A blank begins every word, so the phrase alone is soon ruled out where the phrase between blanks is not.
    as_words = F.contains("_line", F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))
    met = lines.join(sought, F.contains("_line", "phrase") & as_words)
    return met.select(*narrow, "phrase").distinct().join(F.broadcast(phrases), "phrase")


#: Words of a phrase around its anchor on which posts are joined with it.
KEY_WORDS = 3


#: Slots of 64 marks each in a sieve: at most so many rows are broadcast, however many phrases there are.
SIEVE_SLOTS = 1 << 20


def _sieved(rows: DataFrame, sought: DataFrame, *by: str) -> DataFrame:
    """Rows without most of those whose values stand in no row of ``sought``, before they are shuffled to be compared."""
    mark = F.pmod(F.xxhash64(*by), F.lit(SIEVE_SLOTS * 64))
    one = F.expr("shiftleft(1L, CAST(_mark % 64 AS INT))")
    slots = sought.select(mark.alias("_mark")).groupBy(F.floor(F.col("_mark") / 64).alias("_slot")).agg(F.bit_or(one).alias("_marks"))
    marked = rows.withColumn("_mark", mark).withColumn("_slot", F.floor(F.col("_mark") / 64)).join(F.broadcast(slots), "_slot")
    return marked.where(F.col("_marks").bitwiseAND(one) != 0).drop("_slot", "_mark", "_marks")


def _shape() -> list[Column]:
    """How many words of a phrase before and behind its anchor belong to its key."""
    b = F.least(F.col("_before"), F.lit(KEY_WORDS - 1))
    return [b.alias("_b"), F.least(F.col("_behind"), F.lit(KEY_WORDS - 1) - b).alias("_f")]


def _met_by_key(each: DataFrame, placed: DataFrame, narrow: list[str], shapes: list, whole: bool) -> DataFrame:
    """Words of posts with the phrases that stand around them; ``whole`` if keys are whole phrases.

    Many phrases may have the same rarest word, and pairs of those with every place of the word would grow
    with the square of the posts. Places of anchors are therefore joined on up to three words of the
    phrase: the anchor, and how many words before and behind it, one row for each such shape of a word. Only
    places that pass two sieves, by word and by key, are shuffled.
    """
    shaped = placed.select("*", *_shape())
    key = F.slice(F.split("phrase", " "), F.col("_before") - F.col("_b") + 1, F.col("_b") + F.col("_f") + 1)
    shaped = shaped.withColumn("_key", F.array_join(key, " "))
    listed = F.array(*(F.struct(F.lit(b).alias("_b"), F.lit(f).alias("_f")) for b, f in shapes))
    places = each.select(*narrow, "_word", "_own", "_near", F.explode(listed).alias("_shape")).select(*narrow, "_word", "_own", "_near", "_shape.*")
    places = _sieved(places.where("_own >= _b"), shaped, "_word", "_b", "_f").drop("_word")
    around = F.slice("_near", F.col("_own") - F.col("_b") + 1, F.col("_b") + F.col("_f") + 1)
    places = _sieved(places.withColumn("_key", F.array_join(around, " ")), shaped, "_b", "_f", "_key")
    if whole:
        return places.drop("_own", "_near").distinct().join(shaped.drop("_word"), ["_b", "_f", "_key"])
    met = places.join(shaped.drop("_word"), ["_b", "_f", "_key"])
    start = F.col("_own") - F.col("_before")
    run = F.when(start >= 0, F.slice("_near", start + 1, F.col("_before") + F.col("_behind") + 1))
    return met.where(F.array_join(run, " ") == F.col("phrase"))


def phrase_hits(posts: DataFrame, phrases: DataFrame, n_phrases: int | None = None) -> DataFrame:
    """Posts without their text, one row per phrase that occurs in them as consecutive words.

    ``phrases`` has a column ``phrase`` in the form given by ``phrase_key`` and may be of any length.
    Words of posts meet phrases where they are the phrase's rarest word and their neighbours are its
    neighbours; longer phrases are compared as a whole then. Each word carries only as many neighbours as the phrases reach. The anchors are a
    written table, so Spark broadcasts them if their size allows it, and else shuffles both sides by
    word and splits frequent ones. Repeated post rows count once. A null text or phrase matches nothing;
    an empty phrase matches texts without words. Where few phrases are known to be given, their longest
    words take the place of the rarest, and posts are split once, not twice; a list of very few is sought in the whole texts.
    """
    narrow = [c for c in posts.columns if c != "text"]
    if n_phrases is not None and n_phrases <= LISTED_PHRASES:
        return _listed_hits(posts, phrases, narrow)
    words = posts.select(*narrow, phrase_words(F.col("text")).alias("_words"))
    few = n_phrases is not None and n_phrases <= FEW_PHRASES
    placed = written(long_anchors(phrases) if few else anchors(words, phrases), "phrase-anchors")
    shape = F.collect_set(F.struct(*_shape())).alias("shapes")  # of at most KEY_WORDS words
    reach = placed.agg(F.max("_before").alias("before"), F.max("_behind").alias("behind"), F.max(F.col("_before") + F.col("_behind")).alias("most"), shape).first()
    before, behind = reach.before or 0, reach.behind or 0
    each = words.select(*narrow, "_words", F.posexplode_outer("_words").alias("_pos", "_word")).where("_word is not null")
    if before + behind:
        begin = F.greatest(F.col("_pos") - before, F.lit(0))
        near = F.slice("_words", begin + 1, F.col("_pos") - begin + behind + 1)
        each = each.select(*narrow, "_word", F.least("_pos", F.lit(before)).alias("_own"), near.alias("_near"))
        met = _met_by_key(each, placed, narrow, sorted(map(tuple, reach.shapes)), reach.most < KEY_WORDS)
    else:
        met = each.select(*narrow, "_word").join(placed, "_word")
    return met.select(*narrow, "phrase").distinct().join(phrases, "phrase")
