"""Named queries and, where SQL can say the same, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def r(value: Column, digits: int = 6) -> Column:
    """Rounded double without negative zero, so both engines print the same."""
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def dr(expr: str, digits: int = 6) -> str:
    """The same rounding in oracle SQL."""
    return f"(round(cast({expr} as double), {digits}) + cast(0 as double))"
