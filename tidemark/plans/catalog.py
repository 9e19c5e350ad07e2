"""All queries by name, with the SQL that states the same result."""

from __future__ import annotations

from tidemark.plans import markup_queries, read_queries, stream_queries

QUERIES = {**markup_queries.QUERIES, **read_queries.QUERIES, **stream_queries.QUERIES}
ORACLES = {**markup_queries.ORACLES, **read_queries.ORACLES, **stream_queries.ORACLES}
