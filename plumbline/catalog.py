"""All queries of the library by name, with their SQL where SQL can express them."""

from __future__ import annotations

from plumbline.plans import cleaning_queries, record_queries, temporal_queries, text_queries, vector_queries  # noqa: F401
from plumbline.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "theme_share_rank_by_year"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
