"""All registered queries."""

from __future__ import annotations

from . import (  # noqa: F401  (importing registers the queries)
    anomaly_queries, check_queries, clean_queries, enrich_queries, profile_queries,
    revenue_queries, run_queries, serving_queries, source_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
