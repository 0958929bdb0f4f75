"""Every registered query of the library with its DuckDB SQL."""

from __future__ import annotations

from corpusmill.queries import Query, aggregates, connectors, documents, extraction, joins, ranking, retrieval, rules, scans, streams

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _area in (scans, rules, joins, aggregates, ranking, documents, retrieval, extraction, streams, connectors):
    QUERIES |= _area.R.queries
    ORACLE_SQL |= _area.R.sql
#: Questions against the corpus: hybrid search, fusion, budget and cited context.
FLAGSHIP = "rag_retrieve"
