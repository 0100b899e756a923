from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trendloom.functions import digest_text as d


def apply(spark, fn, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "v STRING")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("• First bullet\\n• Second bullet\\n• Third bullet", "• First bullet\n• Second bullet\n• Third bullet"),
        ("•─Rates─cut─again", "• Rates cut again"),
        ("Some text• Bullet one• Bullet two", "Some text\n• Bullet one\n• Bullet two"),
        ("Too    many   spaces   here", "Too many spaces here"),
        ("", ""),
        (None, None),
        ("│a│ ┌┐└┘", "|a| ++++"),
    ],
)
def test_sanitize(spark, raw, clean):
    assert apply(spark, d.sanitize, raw) == [clean]


def test_sentiment(spark):
    texts = ["Bullish!", "BEARISH", "bullish and bearish", "mixed bag", "calm", "bullish but mixed"]
    assert apply(spark, d.sentiment, *texts) == ["bullish", "bearish", "mixed", "mixed", "neutral", "bullish"]


def test_categories(spark):
    df = spark.createDataFrame([(["$NVDA", "Tech Layoffs", "#x", "Gold", "Tech"],)], "v ARRAY<STRING>")
    assert df.select(d.trend_categories(F.col("v"))).first()[0] == ["commodity", "hashtag", "sector", "stock"]


DIGEST = (
    "**Assessment:**\nA long\n day.\n\n**Trends Observed:**\n- Egg Shortage\n• egg shortage\n- abc\n- Copper deficit\n\n"
    "**Bottom Line:**\nWorries about tariffs, and questions regarding\nchips remain."
)


@pytest.mark.parametrize("colon", [":**", "**:", "**"])
def test_sections_with_colon_inside_outside_or_missing(spark, colon):
    body = DIGEST.replace(":**", colon)
    assert apply(spark, d.themes, body) == [["Egg Shortage", "Copper deficit", "tariffs", "chips remain"]]
    assert apply(spark, d.summary, body) == ["Worries about tariffs, and questions regarding chips remain."]


def test_summary_falls_back(spark):
    texts = ["**Assessment:**\n Fine.\n\n**Other:** x", "First part\nof it\n\nsecond", "**Summary:** S" + "x" * 600]
    got = apply(spark, d.summary, *texts)
    assert got[:2] == ["Fine.", "First part\nof it"]
    assert len(got[2]) == 500


def test_theme_limit(spark):
    body = "**Trends Observed:**\n" + "\n".join(f"- theme {i}" for i in range(15))
    assert apply(spark, d.themes, body) == [[f"theme {i}" for i in range(10)]]


def test_recovered_parts(spark):
    body = '**Subject Line**: "Eggs again"\n**Signal Strength**: HIGH\n\nThe body.'
    assert apply(spark, d.recovered_subject, body, "none") == ["Eggs again", None]
    texts = [body, "signal: medium", "Signal none", "nothing", "high but no s-word"]
    assert apply(spark, d.recovered_signal, *texts) == ["high", "medium", "none", "low", "low"]
    assert apply(spark, d.recovered_body, body) == ["The body."]


def test_memory_text(spark):
    row = spark.range(1).select(
        F.lit("2024-01-05").cast("date").alias("day"),
        F.array(F.lit("$A"), F.lit("B")).alias("t"),
        F.array().cast("array<string>").alias("none"),
    )
    made = row.select(
        d.memory_text(F.col("day"), F.lit("low"), F.lit("mixed"), F.col("t"), F.col("t"), F.col("none"), F.lit("s"))
    ).first()[0]
    assert made == "Date: 2024-01-05\nSignal: low\nSentiment: mixed\nTrends: $A, B\nCategories: $A, B\nThemes: \nSummary: s"
    asked = row.select(d.query_text(F.col("t"), F.col("none"), F.lit("mixed"), F.lit("low"))).first()[0]
    assert asked == "Trends: $A, B\nThemes: \nSentiment: mixed\nSignal: low"
