"""Registered queries: each wires operators to the given tables and states the same result in SQL."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every catalog module so that its queries are registered."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
