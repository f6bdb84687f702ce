"""All named queries of the library and their SQL oracles."""

from __future__ import annotations

from maskwell.plans import explain, history, language, ledger, passes, pii, records, wire

MODULES = (pii, language, records, wire, passes, ledger, history, explain)
QUERIES: dict = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
