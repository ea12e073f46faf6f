"""Queries over the driver's tables, by topic."""

from importlib import import_module
from pkgutil import iter_modules


def load() -> None:
    """Import every topic, so that its queries are registered."""
    for m in iter_modules(__path__):
        import_module(f"{__name__}.{m.name}")
