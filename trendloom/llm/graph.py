"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import FEW_ROWS, discard, written


def _least(pairs: DataFrame, small: bool) -> DataFrame:
    """u, v, m: every pair and the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(F.broadcast(least) if small else least, "u")


def components(links: DataFrame, a: str = "a", b: str = "b", purpose: str = "components") -> DataFrame:
    """id and component (the least id reachable) of every id that has a link to another.

    Large-star and small-star steps alternate until nothing changes: each hangs neighbours onto the
    least id nearby, so that chains halve and hubs never meet in one list. Every round is a written
    table, and no links come to the driver but their number and a checksum.
    """
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    links = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), purpose)
    before = (links.count(), None)
    while True:
        small = before[0] <= FEW_ROWS  # a star step has no more groups than links have ends
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, small).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = _least(large, small)
        stars = lower.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            lower.select("u", F.col("m").alias("v"))
        )
        last, links = links, written(stars.where("u != v").distinct(), purpose)
        discard(last)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    stars = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
