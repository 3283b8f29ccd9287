"""Registered queries over the driver's tables, each beside its SQL."""

import importlib
import pkgutil

from catalog.registry import QUERIES, SQL

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.endswith("_queries")):
    importlib.import_module(f"catalog.{_module}")

__all__ = ["QUERIES", "SQL"]
