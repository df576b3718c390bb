"""All queries of this package (the optional operators register their own)."""

from __future__ import annotations

from strandline.plans import file_queries, graph_queries, more_queries

QUERIES = graph_queries.QUERIES | file_queries.QUERIES | more_queries.QUERIES
SQL = graph_queries.SQL | file_queries.SQL | more_queries.SQL
