"""All queries of the library and their DuckDB twins."""

from __future__ import annotations

from . import graphs, metrics, preparation, recipes

MODULES = (preparation, graphs, metrics, recipes)
QUERIES = {name: f for m in MODULES for name, f in m.Q.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.SQL.items()}
