"""All registered queries."""

from lotlens.plans import annotated_queries, crawl_queries, deal_queries, log_queries, market_queries, search_queries, stream_queries, text_queries  # noqa: F401
from lotlens.plans.registry import CHECKS, QUERIES  # noqa: F401
