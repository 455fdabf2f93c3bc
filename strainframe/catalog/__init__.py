"""Registered queries, grouped by the work they do."""

from __future__ import annotations

import importlib
import pkgutil


def load_catalog():
    """Import every catalog module once and return (queries, oracle statements)."""
    from strainframe.catalog import registry

    for module in sorted(info.name for info in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    return registry.QUERIES, registry.ORACLES
