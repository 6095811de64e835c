"""Named queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def settled(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n, t in df.dtypes if t == "double"})


def query(name: str, sql: str | None = None, digits: int = DIGITS):
    """Register a query; its doubles are rounded on both sides (eight digits where means could tie at the seventh)."""
    def deco(fn):
        QUERIES[name] = lambda spark, sf: settled(fn(spark, sf), digits)
        QUERIES[name].__doc__ = fn.__doc__
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return deco
