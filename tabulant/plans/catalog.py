"""All registered queries: importing the modules registers them."""

import importlib

from tabulant.plans.registry import ORACLES, QUERIES

MODULES = ["queries_profile", "queries_features", "queries_stats", "queries_search", "queries_series", "queries_models", "queries_properties", "queries_flow"]

for _name in MODULES:
    importlib.import_module(f"tabulant.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
