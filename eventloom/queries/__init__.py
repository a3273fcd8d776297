"""Queries over the driver's tables, one per operator, with their DuckDB SQL."""

from . import history, indexing, ingest, retrieval, rollups, whole_tables

_MODULES = (retrieval, history, rollups, ingest, whole_tables, indexing)

QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
