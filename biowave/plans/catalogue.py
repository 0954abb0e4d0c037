"""The queries of the library over the driver's tables, with their SQL twins."""

from __future__ import annotations

from biowave.plans import draw_queries, relational_queries, sample_queries, segment_queries, sequence_queries, signal_queries

_PARTS = (sequence_queries, segment_queries, relational_queries, signal_queries, sample_queries, draw_queries)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
