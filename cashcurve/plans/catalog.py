"""All registered queries: importing the query modules fills the registry."""

from __future__ import annotations

from cashcurve.plans import forecast_queries, runway_queries, statement_queries, kpi_queries, project_queries, ledger_queries, actuals_queries, update_queries, insert_queries, onboarding_queries, quality_queries, extension_queries, stream_queries, store_queries  # noqa: F401
from cashcurve.plans.registry import NO_ORACLE_REASON, ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE", "NO_ORACLE_REASON"]
