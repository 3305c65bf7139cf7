"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from turnout.plans.standin import StandIn, check_ctes


@dataclass(frozen=True)
class Query:
    run: Callable[[StandIn], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the stand-in tables under ``name``."""

    def register(run: Callable[[StandIn], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = Query(run, sql)
        return run

    return register


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name].run(StandIn(spark, folder))


def check_sql(name: str) -> str | None:
    """The query's SQL with the stand-in tables it names as leading CTEs."""
    body = QUERIES[name].sql
    if body is None:
        return None
    ctes = check_ctes()
    used = [n for n in ctes if n in body]
    leading = ",\n".join(f"{n} AS ({ctes[n].strip()})" for n in used)
    body = body.strip()
    if not leading:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {leading},\n{body[5:]}"
    return f"WITH {leading}\n{body}"
