"""All queries of this package's operators over the test tables, by name, and their SQL."""

from __future__ import annotations

from . import data_queries, data_sql, interval_queries, more_queries, repair_queries, source_queries

QUERIES = interval_queries.QUERIES | data_queries.QUERIES | source_queries.QUERIES | more_queries.QUERIES | repair_queries.QUERIES
ORACLE_SQL = interval_queries.ORACLE_SQL | data_sql.ORACLE_SQL | source_queries.ORACLE_SQL | more_queries.ORACLE_SQL | repair_queries.ORACLE_SQL
