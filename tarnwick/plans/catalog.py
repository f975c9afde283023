"""All queries over the driver's tables."""

from __future__ import annotations

from tarnwick.plans import decision_queries, event_queries, fit_queries, measure_queries, picture_queries, record_queries, rule_queries, score_queries, series_queries, task_queries  # noqa: F401  they register their queries
from tarnwick.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "by_model_summary"
