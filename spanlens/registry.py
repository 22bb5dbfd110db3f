"""The queries of the library and the SQL with the same results."""

from __future__ import annotations

from spanlens.plans import analytics_queries, lookup_queries, more_queries, range_queries, retrieval_queries, session_queries, store_queries, text_queries  # noqa: F401  (they register their queries)
from spanlens.plans.base import ORACLES, QUERIES

FLAGSHIP = retrieval_queries.flagship
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
