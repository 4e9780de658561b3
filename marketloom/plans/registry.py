"""All queries of the library and their SQL."""

from __future__ import annotations

from marketloom.plans import comparisons, daily, discoveries, ledgers, modelling, records, sessions, studies, variants

_MODULES = (daily, studies, ledgers, comparisons, sessions, variants, discoveries, modelling, records)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
