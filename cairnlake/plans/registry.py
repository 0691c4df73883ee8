"""All registered queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules that hold a ``PLANS`` list.
MODULES: list[str] = ["text_quality", "lexical", "rank", "evaluate", "access", "graph", "relational", "streaming", "selection", "documents"]


@dataclass(frozen=True)
class Plan:
    """A query, its name, and the SQL that gives the same rows (None where SQL can't)."""

    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def plans() -> dict[str, Plan]:
    found: dict[str, Plan] = {}
    for module in MODULES:
        for plan in import_module(f"cairnlake.plans.{module}").PLANS:
            if plan.name in found:
                raise ValueError(f"two plans are named {plan.name}")
            found[plan.name] = plan
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: plan.run for name, plan in plans().items()}


def oracle_sql() -> dict[str, str]:
    return {name: plan.sql for name, plan in plans().items() if plan.sql}
