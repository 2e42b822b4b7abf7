"""Import every query module so that the registry is complete."""

from __future__ import annotations

import importlib

from millrun.plans.registry import ORACLE, QUERIES

MODULES = [
    "millrun.plans.erp_queries",
    "millrun.plans.plant_queries",
    "millrun.plans.text_queries",
    "millrun.plans.planning_queries",
    "millrun.plans.finance_queries",
    "millrun.plans.lab_queries",
    "millrun.plans.streaming_queries",
    "millrun.plans.ml_queries",
    "millrun.plans.io_queries",
    "millrun.plans.commercial_queries",
    "millrun.plans.reliability_queries",
    "millrun.plans.field_queries",
]

for _m in MODULES:
    importlib.import_module(_m)

__all__ = ["QUERIES", "ORACLE"]
