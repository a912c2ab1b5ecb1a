"""Registered queries: a name, the Spark plan, and the SQL that must give the same rows (when SQL can express it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assaykit.operators.hotkeys import spread

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under a name, with its checking SQL."""

    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} registered twice")
        PLANS[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. Parquet carries its own declared schema."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A given table for row-wise heavy work: a single small file is spread over the cores first."""
    return spread(table(spark, sf_dir, name), key)


def sql_list(values: list[str]) -> str:
    """A list of strings as a SQL literal."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_strings(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
