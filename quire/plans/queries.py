"""All registered queries."""

from quire.plans import cart_queries, catalog_queries, order_queries, request_queries, user_queries  # noqa: F401
from quire.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
