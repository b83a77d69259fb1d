"""Queries over the driver's tables."""

from importlib import import_module
from pkgutil import iter_modules

from planloom.workload.registry import ORACLES, QUERIES

for _m in iter_modules(__path__):
    if _m.name.startswith("q_"):
        import_module(f"{__name__}.{_m.name}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
