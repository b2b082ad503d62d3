"""All queries of the library's own operators, and their SQL."""

from trendspark.plans import search_queries, table_queries, text_queries, trend_queries

_MODULES = (trend_queries, text_queries, table_queries, search_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
