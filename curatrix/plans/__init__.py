"""Bindings of the operators to the driver tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import importlib

MODULES = ("text", "joins", "matching", "groups", "ranking", "pages", "reviews", "media", "geometry")


def load():
    """``(queries, sql)`` of all plan modules."""
    from curatrix.plans import registry

    for name in MODULES:
        importlib.import_module(f"curatrix.plans.{name}")
    return registry.QUERIES, registry.SQL
