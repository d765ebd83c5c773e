"""Every operator as a query over the test tables, with its SQL twin."""

import importlib
import pkgutil


def load():
    """Import every catalog module and return (queries, oracles)."""
    from turnloom.catalog import registry

    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return registry.QUERIES, registry.ORACLES
