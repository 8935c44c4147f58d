"""Registered queries over the driver tables."""

from importlib import import_module
from pkgutil import iter_modules


def load_queries() -> None:
    """Import every query module; importing registers its queries."""
    for module in iter_modules(__path__):
        if module.name.endswith("_queries"):
            import_module(f"{__name__}.{module.name}")
