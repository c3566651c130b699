"""Registered queries over the given tables, and their oracle SQL."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> tuple[dict, dict]:
    """(queries, oracles) by name, after importing every query module of this package."""
    from . import registry

    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")
    return registry.QUERIES, registry.ORACLES
