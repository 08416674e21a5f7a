"""All queries of the core and their SQL."""

from __future__ import annotations

from quernstone.plans import combining, evaluation, extra, feeds, heavy, issues, profiling, reporting, stage0

_MODULES = (heavy, stage0, reporting, evaluation, profiling, issues, feeds, extra, combining)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
