"""Scalar semantics of the dialect where they differ from Spark's: division, truth of values, two-valued logic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Integer quotient, truncated toward zero; NULL when b is 0."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def real_div(a: Column, b: Column) -> Column:
    """Quotient of doubles; NULL when b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def truthy(value: Column, kind: str, nullable: bool) -> Column:
    """A value as a predicate: non-zero numbers and non-empty strings hold; NULL does not."""
    test = value if kind == "bool" else value != F.lit("") if kind == "text" else value != F.lit(0)
    return F.coalesce(test, F.lit(False)) if nullable else test
