"""Queries over the provided tables, each with SQL to compare against."""

from importlib import import_module

MODULES = (
    "growth",
    "etl",
    "integration",
    "profiling",
    "labels",
    "scoring",
    "modeling",
    "marts",
)


def load_registry():
    for name in MODULES:
        import_module(f"cellwise.plans.{name}")
    from cellwise.plans.registry import REGISTRY

    return REGISTRY
