"""Queries over the driver tables with equivalent SQL."""

from importlib import import_module

MODULES = ["analysis", "decode", "scalars", "convert", "commands", "streams"]


def _merged(attribute):
    found = {}
    for name in MODULES:
        found.update(getattr(import_module(f"{__name__}.{name}"), attribute))
    return found


def queries():
    return _merged("QUERIES")


def oracle_sql():
    return _merged("ORACLE")
