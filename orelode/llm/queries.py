"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from orelode.llm import chunks, copies, encoding, leakage, names, packing, prose, reference_list, scans

MODULES = (reference_list, copies, scans, encoding, chunks, names, packing, leakage, prose)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
