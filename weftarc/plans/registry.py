"""All queries over the archive tables by name, with the SQL they are held against."""

from __future__ import annotations

from weftarc.plans import capture_queries, web_queries

QUERIES = web_queries.QUERIES | capture_queries.QUERIES
ORACLE_SQL = web_queries.ORACLE_SQL | capture_queries.ORACLE_SQL
FLAGSHIP = web_queries.pth_hosts
