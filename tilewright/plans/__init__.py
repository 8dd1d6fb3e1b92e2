"""Queries over the driver tables, each with its equivalent SQL."""

from __future__ import annotations

import importlib
import pkgutil


def all_queries() -> dict:
    """Every registered query by name."""
    for info in pkgutil.iter_modules(__path__):
        if info.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{info.name}")
    from tilewright.plans.registry import QUERIES

    return dict(QUERIES)
