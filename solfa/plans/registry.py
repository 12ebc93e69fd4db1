"""Queries over the driver's tables, by name, with their DuckDB twins."""

from . import catalog, entities, exchanges, layouts, overlays, reshapes

MODULES = (catalog, entities, overlays, exchanges, reshapes, layouts)
QUERIES: dict = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
