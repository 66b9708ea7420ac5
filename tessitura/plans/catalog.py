"""Named queries over the driver's tables, and their SQL."""

from __future__ import annotations

from . import sequence_queries, source_queries, stream_queries, text_queries

QUERIES: dict = text_queries.QUERIES | sequence_queries.QUERIES | stream_queries.QUERIES | source_queries.QUERIES
ORACLE_SQL: dict = text_queries.ORACLE_SQL | sequence_queries.ORACLE_SQL | stream_queries.ORACLE_SQL | source_queries.ORACLE_SQL
