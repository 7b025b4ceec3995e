"""Registry of named queries and of the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _nudge(digits: int) -> float:
    """A shift far below the last kept digit: values that sit exactly on a rounding tie leave it."""
    return float(f"3.7e-{digits + 3}")


def rounded(df: DataFrame, columns: Iterable[str], digits: int = 6) -> DataFrame:
    """Round doubles for comparison; adding 0.0 turns a negative zero into zero."""
    columns = set(columns)

    def one(c: str):
        return (F.round(F.col(c) + F.lit(_nudge(digits)), digits) + F.lit(0.0)).alias(c) if c in columns else F.col(c)

    return df.select(*[one(c) for c in df.columns])


def rnd(expression: str, digits: int = 6) -> str:
    """SQL text of the same rounding."""
    return f"(round({expression} + {_nudge(digits)!r}::DOUBLE, {digits}) + 0.0)"


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"{rnd(expression, digits)} AS {name}"
