"""All registered queries. Importing the modules below fills the registry."""

import importlib

from tidemark.plans.registry import ORACLES, QUERIES

MODULES = (
    "sources", "cleaning", "text", "alignment", "features", "labels", "outcomes", "statistics", "filings",
    "reports", "basics", "models", "streaming", "dataset",
)

for _m in MODULES:
    try:
        importlib.import_module(f"tidemark.plans.{_m}_queries")
    except ModuleNotFoundError as e:  # built up module by module
        if f"{_m}_queries" not in str(e):
            raise

__all__ = ["ORACLES", "QUERIES"]
