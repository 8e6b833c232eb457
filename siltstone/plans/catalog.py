"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from siltstone.plans import audit_plans, feed_plans, relational_plans, search_plans, state_plans, stream_plans, text_plans
from siltstone.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "audit_plans", "feed_plans", "relational_plans", "search_plans", "state_plans", "stream_plans", "text_plans"]
