"""Registered queries over the star-schema test tables."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every ``q_*`` module once and return ``(queries, oracles)``."""
    from tidemark.plans import catalog
    for mod in pkgutil.iter_modules(__path__):
        if mod.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{mod.name}")
    return catalog.QUERIES, catalog.ORACLES
