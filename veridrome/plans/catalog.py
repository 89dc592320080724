"""All registered queries of the core, gathered from the modules beside."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
#: Modules with ``QUERIES`` and ``SQL``.
MODULES = ("records", "text_queries", "event_queries", "rule_queries", "more_queries", "entity_queries", "inventory_queries")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in MODULES:
        out |= import_module(f"veridrome.plans.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= import_module(f"veridrome.plans.{m}").SQL
    return out
