"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from corvane.plans import audit_queries, checking_queries, chunk_queries, context_queries, control_queries, graph_queries, log_queries, quality_queries, retrieval_queries, search_queries, streaming_queries, understanding_queries

MODULES = (search_queries, context_queries, graph_queries, log_queries, quality_queries, control_queries, understanding_queries, checking_queries, chunk_queries, audit_queries, retrieval_queries, streaming_queries)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
