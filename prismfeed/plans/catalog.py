"""All queries: importing the modules registers them."""

from prismfeed.plans import serving_queries, stream_queries, table_queries, text_queries  # noqa: F401
from prismfeed.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
