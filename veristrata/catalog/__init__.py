"""Named queries over a folder of tables, with the SQL that must give the same rows."""

from veristrata.catalog import graph_queries, hierarchy_queries, index_queries, ledger_queries, search_queries, vector_queries

_PARTS = (search_queries, graph_queries, vector_queries, ledger_queries, index_queries, hierarchy_queries)
CORE_QUERIES = {k: q for part in _PARTS for k, q in part.QUERIES.items()}
CORE_ORACLE = {k: q for part in _PARTS for k, q in part.ORACLE.items()}
