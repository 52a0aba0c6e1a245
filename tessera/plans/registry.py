"""All core queries and their SQL."""

from __future__ import annotations

from tessera.plans import corpus, logs, panel, schemes, sets, texts

MODULES = (corpus, panel, schemes, sets, logs, texts)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in MODULES for name, text in module.SQL.items()}
