"""Queries register themselves here by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def rounded(x: Column, digits: int) -> Column:
    """As SQL's round() has it for doubles: the product with a power of ten is rounded, so that 1.0484375, whose double lies below, goes down; where it overflows, x stays."""
    scale = float(10**digits)
    return F.when(F.abs(x * scale) < float("inf"), F.round(x * scale) / scale).otherwise(x)


def r6(x: Column | str, name: str | None = None) -> Column:
    """To six decimals: sums in another order then give the same value."""
    out = rounded(F.col(x) if isinstance(x, str) else x, 6)
    return out.alias(name or x) if name or isinstance(x, str) else out
