"""Registered queries of the library: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

import importlib
import pkgutil

from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "load"]


def load() -> list[str]:
    """Import every module of this package, so that its queries are registered."""
    names = sorted(m.name for m in pkgutil.iter_modules(__path__))
    for name in names:
        importlib.import_module(f"{__name__}.{name}")
    return names
