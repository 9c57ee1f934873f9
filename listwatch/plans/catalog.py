"""Imports every query module and hands out the registry."""

from importlib import import_module

from listwatch.plans.registry import REGISTRY, Query

MODULES = ("state_queries", "merge_queries", "diff_queries", "classify_queries", "report_queries",
           "source_queries", "store_queries", "record_queries")


def all_queries() -> dict[str, Query]:
    for module in MODULES:
        import_module(f"listwatch.plans.{module}")
    return dict(REGISTRY)
