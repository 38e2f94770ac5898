"""All registered queries of the reconciliation engine and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

PLANS = ["relational", "text", "reconciliation", "extraction", "store", "invoices", "forms", "mails", "captures", "layouts"]


def _plans() -> list:
    return [import_module(f"ledgerspark.plans.{name}") for name in PLANS]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for plan in _plans() for k, v in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for plan in _plans() for k, v in plan.SQL.items()}
