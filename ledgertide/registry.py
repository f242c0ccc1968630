"""All queries by name, and the SQL that an independent engine answers them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgertide.plans import audit, core, district, grading, inference, intake, portable, published

PLANS = (portable, core, inference, district, grading, audit, published, intake)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for plan in PLANS for k, v in plan.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for plan in PLANS for k, v in plan.oracle_sql().items()}
