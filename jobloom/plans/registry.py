"""Named queries over the views, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobloom.sources.tables import VIEWS_SQL, Views

Plan = Callable[[Views], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan; sql is what follows the views' WITH clause, recursive where it asks for it."""

    def keep(plan: Plan) -> Plan:
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = f"WITH RECURSIVE {VIEWS_SQL.strip()}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return plan

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: plan(Views(spark, sf_dir))

    return {name: bound(plan) for name, plan in PLANS.items()}
