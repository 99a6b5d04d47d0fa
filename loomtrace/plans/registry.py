"""All queries of the core, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("packing_queries", "profile_queries", "preparation_queries", "retrieval_queries", "experiment_queries", "boundary_queries")


def _gather(what: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(importlib.import_module(f"loomtrace.plans.{module}"), what)
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gather("QUERIES")


def oracles() -> dict[str, str]:
    return _gather("ORACLES")
