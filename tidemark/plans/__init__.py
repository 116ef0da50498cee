"""Registered queries by section, each with the SQL that defines its result."""

import importlib
import pkgutil


def load():
    """Import every section and return ``(queries, sql)``."""
    from tidemark.plans.registry import QUERIES, SQL

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return QUERIES, SQL
