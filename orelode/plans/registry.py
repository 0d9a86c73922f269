"""Queries of the fact engine and their SQL."""

from __future__ import annotations

from orelode.plans import answers, graphs, pipeline, scalars

MODULES = (scalars, graphs, answers, pipeline)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
