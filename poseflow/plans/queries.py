"""Queries over the given tables for the operators, each with its SQL for DuckDB."""

from __future__ import annotations

from . import evaluation, geometry, pipeline_tables, readers, structures, tables, variants

_ALL = (evaluation, geometry, tables, structures, pipeline_tables, readers, variants)
QUERIES = {name: fn for module in _ALL for name, fn in module.REGISTRY.queries.items()}
ORACLE_SQL = {name: sql for module in _ALL for name, sql in module.REGISTRY.sql.items()}
