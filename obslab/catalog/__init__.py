"""Queries over the bundled test tables, with the SQL that states the same result.

Each module fills two dictionaries: ``QUERIES`` (name to a function of session
and table folder) and ``SQL`` (name to a statement over the same tables).
"""

from obslab.catalog import identity, metrics, models, profiling, quality, splits, stores, streams

MODULES = (profiling, quality, identity, splits, metrics, models, stores, streams)


def all_queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
