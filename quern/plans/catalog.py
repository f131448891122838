"""All queries outside the optional subpackage."""

from __future__ import annotations

from quern.plans import assessment, evaluation, history, rendering

_MODULES = (history, assessment, evaluation, rendering)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
