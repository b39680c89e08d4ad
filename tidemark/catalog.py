"""Every query of the library by name, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from tidemark.plans import chunks, curate, graph, metrics, monitor, relational, search, streams, tables, text, tools, vectors

MODULES = (search, text, tools, chunks, metrics, monitor, graph, vectors, relational, curate, tables, streams)
QUERIES = {name: query for m in MODULES for name, query in m.query.queries.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.query.sql.items()}
