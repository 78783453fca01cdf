"""Queries over the given tables."""

import importlib
import pkgutil

from docweave.plans.registry import ORACLES, QUERIES

for _m in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_m.name}")

__all__ = ["ORACLES", "QUERIES"]
