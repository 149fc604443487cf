"""The library's registered queries."""

from importlib import import_module

from millrace.plans.registry import QUERIES, SQL

MODULES = ("relational_queries", "graph_fact_queries", "search_queries", "text_queries", "maintenance_queries", "stage_queries", "knowledge_queries", "context_queries", "index_queries", "name_queries", "edit_queries", "code_queries", "analysis_queries", "link_queries")
for _name in MODULES:
    import_module(f"millrace.plans.{_name}")

__all__ = ["QUERIES", "SQL"]
