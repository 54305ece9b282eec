"""Every core query with its DuckDB twin, by name."""

from __future__ import annotations

from . import api_queries, dashboard_queries, detail_queries, kpi_queries, list_queries, practice_queries, registry_queries, source_queries, upload_queries

QUERIES: dict = {}
ORACLE: dict = {}
for module in (kpi_queries, practice_queries, source_queries, registry_queries, api_queries, list_queries, dashboard_queries, upload_queries, detail_queries):
    QUERIES.update(module.QUERIES)
    ORACLE.update(module.ORACLE)
