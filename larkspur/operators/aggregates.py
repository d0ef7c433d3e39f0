"""Grouping and top-k helpers; all of them are partial aggregations before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped(df: DataFrame, keys: list[Column], aggregates: list[Column]) -> DataFrame:
    """GROUP BY: distinct keys if there are no aggregates, one row if there are no keys."""
    if not aggregates:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """ORDER BY ... LIMIT n, which Spark runs as a bounded heap per task."""
    return df.orderBy(*order).limit(n)


def frequent(df: DataFrame, column: str, n: int = 32) -> DataFrame:
    """The n most frequent values, exactly: value, rows."""
    return top(df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows")), [F.desc("rows"), F.asc("value")], n)
