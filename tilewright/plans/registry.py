"""Registry of the named queries: what runs on Spark, the equivalent SQL and the inventory entries it covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` under its own name."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        name = build.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, tuple(covers.split()), build, sql)
        return build

    return register


def r6(*names: str, digits: int = 6) -> dict:
    """``withColumns`` argument rounding the named columns."""
    from pyspark.sql import functions as F

    return {n: F.round(n, digits) for n in names}


def scaled6(*names: str) -> dict:
    """As :func:`r6`, by the rounding of the SQL: the scaled double to its nearest integer. Of numbers with seven decimals, a
    few that end in 5 differ."""
    from pyspark.sql import functions as F

    return {n: F.round(F.col(n) * 1e6, 0) / 1e6 for n in names}
