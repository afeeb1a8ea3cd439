"""The registered queries and their SQL, gathered from the modules of this folder."""

from __future__ import annotations

from . import analysis_queries, factor_queries, file_queries, quality_queries, trading_queries, weight_queries

MODULES = (factor_queries, quality_queries, analysis_queries, weight_queries, trading_queries, file_queries)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
