"""Every registered query with its SQL twin."""

from __future__ import annotations

from .operators import budgets, content, cost_model, decisions, entities, folds, gates, graphs, guards, line_diff, neighbours, planners, quality, ranked, relational, roi, scanners, sequences, session_view, spend
from .plans.dialect import bind
from .sources import appended
from .streaming import stateful

QUERIES, ORACLE_SQL = bind(spend.QUERIES | sequences.QUERIES | relational.QUERIES | decisions.QUERIES | gates.QUERIES)
QUERIES |= graphs.QUERIES | ranked.QUERIES
ORACLE_SQL |= graphs.ORACLE_SQL
for module in (budgets, content, cost_model, entities, folds, guards, line_diff, neighbours, planners, quality, roi, scanners, session_view, appended, stateful):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
