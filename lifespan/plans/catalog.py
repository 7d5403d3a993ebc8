"""Imports every query module so that all queries are registered."""

from lifespan.plans import expert_queries, map_queries, rule_queries, score_queries, upload_queries, window_queries  # noqa: F401
from lifespan.plans.registry import ORACLES, QUERIES  # noqa: F401
