"""Registered queries by area."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every module of registered queries once."""
    for m in pkgutil.iter_modules(__path__):
        if m.name != "registry":
            importlib.import_module(f"{__name__}.{m.name}")
