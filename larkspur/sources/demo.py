"""Demo tables. Uniform ones are Spark ranges; skewed ones use a counter-based generator, so any row can be drawn alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values that the demo's answers rest on: multipliers of the generator, regions by falling
#: frequency, statuses, and cumulative shares.
GAMMA, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
REGIONS = (
    "north", "south", "east", "west", "central", "coast", "valley", "metro", "harbor", "plains", "delta", "ridge", "lakes",
    "forest", "desert", "island", "canyon", "summit", "bay", "prairie", "tundra", "basin", "mesa", "grove", "fjord",
)
STATUSES = ("DELIVERED", "SHIPPED", "PROCESSING", "CANCELLED", "RETURNED")
STATUS_UP_TO = (0.70, 0.85, 0.93, 0.98)
TIER_UP_TO = (0.60, 0.85, 0.95)
ORDERS_FROM_DRAW = 30_001


def draws(seed: int, n: np.ndarray) -> np.ndarray:
    """The n-th draws (from 1) of a seed, unsigned 64-bit with wrap-around."""
    with np.errstate(over="ignore"):
        x = np.uint64(seed) + n.astype(np.uint64) * np.uint64(GAMMA) + np.uint64(GAMMA)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
        return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def zipf_index(u: np.ndarray, n: int, s: float) -> np.ndarray:
    shares = np.cumsum(np.arange(1, n + 1, dtype=np.float64) ** -s)
    return np.minimum(np.searchsorted(shares / shares[-1], u, side="left"), n - 1)


def small_tables(spark: SparkSession) -> dict[str, DataFrame]:
    i = F.col("id")
    rows = lambda n: spark.range(1, n + 1)
    course = lambda x: F.concat(F.lit("CS"), x.cast("string"))
    return {
        "students": rows(100).select(i.alias("id"), F.concat(F.lit("Student"), i).alias("name"), (18 + i % 5).alias("age")),
        "grades": rows(500).select((1 + i % 100).alias("student_id"), course(i % 10).alias("course"), (60 + i % 41).alias("grade")),
        "enrollments": rows(100).select((1 + i % 100).alias("student_id"), course(i % 10).alias("course_id"), F.lit("Fall2024").alias("semester")),
        "courses": rows(10).select(course(i).alias("id"), F.concat(F.lit("Course"), i).alias("title")),
    }


def large_tables(spark: SparkSession) -> dict[str, DataFrame]:
    i = F.col("id")
    return {
        "huge_users": spark.range(1, 100_001).select(i.alias("id"), F.concat(F.lit("Region"), i % 50).alias("region")),
        "huge_transactions": spark.range(1, 500_001).select(i.alias("tx_id"), (1 + i % 100_000).alias("user_id"), (10 + i % 900).alias("amount")),
    }


def skewed_tables(spark: SparkSession, seed: int = 7) -> dict[str, DataFrame]:
    """customers and orders."""

    def customers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            i = f["id"].to_numpy()
            at = 1 + 3 * (i - 1)
            tier = 1 + np.searchsorted(TIER_UP_TO, unit(draws(seed, at)), side="right")
            region = np.array(REGIONS)[zipf_index(unit(draws(seed, at + 1)), len(REGIONS), 1.0)]
            day = 1 + (draws(seed, at + 2) % np.uint64(1000)).astype(np.int64)
            yield pd.DataFrame({"c_id": i, "region": region, "tier": tier, "signup_day": day})

    def orders(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            i = f["id"].to_numpy()
            at = ORDERS_FROM_DRAW + 5 * (i - 1)
            u1, u2, us, uw, uc = (unit(draws(seed, at + k)) for k in range(5))
            normal = np.sqrt(-2 * np.log(np.maximum(u1, 1e-12))) * np.cos(6.283185307179586 * u2)
            amount = np.floor(np.exp(3.5 + normal) * 100 + 0.5) / 100
            status = np.array(STATUSES)[np.searchsorted(STATUS_UP_TO, us, side="right")]
            day = np.maximum(1, 365 - np.trunc(365 * uw * uw)).astype(np.int64)
            yield pd.DataFrame({"o_id": i, "customer_id": 1 + zipf_index(uc, 10_000, 1.1), "amount": amount, "status": status, "day": day})

    return {
        "customers": spark.range(1, 10_001).mapInPandas(customers, "c_id long, region string, tier long, signup_day long"),
        "orders": spark.range(1, 200_001).mapInPandas(orders, "o_id long, customer_id long, amount double, status string, day long"),
    }


INDEXES = {"students": "id", "huge_users": "id", "huge_transactions": "user_id", "customers": "c_id", "orders": "customer_id"}


def load(engine, large: bool = True, skewed: bool = True, seed: int = 7) -> None:
    """Puts the demo tables and their indexes into an engine."""
    spark = engine.spark
    tables = small_tables(spark) | (large_tables(spark) if large else {})
    if skewed:
        tables |= skewed_tables(spark, seed)
    keys = {"students": "id", "grades": "student_id", "enrollments": "student_id", "huge_users": "id", "huge_transactions": "tx_id", "customers": "c_id", "orders": "o_id"}
    for name, df in tables.items():
        engine.catalog.load(name, df, keys.get(name))
        if name in INDEXES:
            engine.catalog.index(f"{name}_{INDEXES[name]}_idx", name, INDEXES[name])
