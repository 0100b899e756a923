"""The corpus pipeline: stages that clean and pack a table of documents, in order.

Each stage takes (spark, docs, folder of base tables) and returns a DataFrame, which is written as
Parquet and read again as the docs of the next. All stages but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trendloom.llm import minhash, packing, pii, repeats, toxicity
from trendloom.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents are near copies if they share four fifths of their five-word shingles.
NEAR = minhash.Rule(words=5, percent=80)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the factorization machine, fitted to the labels, does not reject."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return minhash.first_of_each(docs, NEAR, repeats=False)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that stand earlier in the corpus too."""
    return repeats.without_repeats(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of personal data in its place."""
    return pii.redact(docs, pii.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of all remaining documents."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near-copies", drop_near_copies),
    ("repeats", drop_repeats),
    ("personal-data", redact),
    ("packing", pack),
]

#: SQL can express neither learned scores nor tokenization; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
