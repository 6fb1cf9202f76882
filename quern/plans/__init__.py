"""The library's queries over the driver's tables, and their SQL."""

from importlib import import_module

MODULES = ["filters", "rules", "joins", "aggregates", "merge", "text", "evaluation", "stores"]


def _registries():
    return [import_module(f"{__name__}.{m}").registry for m in MODULES]


def queries():
    return {k: v for r in _registries() for k, v in r.queries.items()}


def oracle_sql():
    return {k: v for r in _registries() for k, v in r.sql.items()}
