"""Registered queries. Importing a module of this package registers what it defines."""

from importlib import import_module

MODULES = ("measure", "preparation", "metrics", "analysis", "geometry", "change", "choice", "validity")


def load_all():
    for name in MODULES:
        import_module(f"conceptframe.plans.{name}")
    from conceptframe.plans.registry import ORACLES, QUERIES
    return dict(QUERIES), dict(ORACLES)
