"""Small tables with the awkward cases every operator has to handle."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators add to their results.
CLASHING = ("start", "length", "score", "key", "tie", "spans", "rep", "label", "bucket", "sig", "n", "y", "kept")

LONG = " ".join(f"word{i % 97} and thing{i % 31}, then on" for i in range(4000))

ROWS = [
    (1, "One small text about a thing.", "en", "a", 29),
    (2, "One small text about a thing.", "en", "a", 29),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \n\t ", "en", "b", 4),
    (6, LONG, "en", "a", len(LONG)),
    (7, LONG, "en", "a", len(LONG)),
    (8, "x" * 70_000, "en", "a", 70_000),
    (9, "Déjà vu — ça va? ΣΑΣ 日本語 \U0001f600", "fr", "c", 30),
    (9, "Déjà vu — ça va? ΣΑΣ 日本語 \U0001f600", "fr", "c", 30),
    (9, "another text under the same id", "en", "c", 30),
    (None, "a text without an id", "en", "c", 20),
    (10, "mail me: jo.doe@mail.example.com or +1 (555) 555-1234, 4111 1111 1111 1111, 10.0.0.255", "en", "c", 80),
]


def documents(spark, rows=ROWS):
    """The rows with extra columns whose names clash with those of results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *(F.lit("extra").alias(c) for c in CLASHING))


def empty(spark):
    return documents(spark).limit(0)
