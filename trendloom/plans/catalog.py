"""All named queries."""

from trendloom.plans import (  # noqa: F401
    digests,
    history,
    market,
    memory,
    posts,
    streams,
    trends,
)
from trendloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
