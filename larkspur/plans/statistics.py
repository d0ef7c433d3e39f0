"""Table statistics: aggregates that Spark runs, and small summaries of them for the estimator."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import neighbours_in_order

MOST_COMMON, BUCKETS, NDV_ERROR = 32, 64, 0.016


@dataclass
class ColumnStats:
    kind: str
    ndv: int = 0
    low: object = None
    high: object = None
    width: float = 9.0
    correlation: float | None = None
    common: dict = field(default_factory=dict)  # value: rows
    buckets: list[tuple[float, float, float]] = field(default_factory=list)  # low, high, rows


@dataclass
class TableStats:
    rows: int
    bytes: int
    columns: dict[str, ColumnStats]


def analyzed(df: DataFrame, columns: dict[str, str], order: str | None = None) -> TableStats:
    """One pass for counts, distinct values (HyperLogLog), bounds and widths; per column a pass for the most common values,
    of which at most 32 come to the driver, and one for 65 bucket bounds."""
    c = lambda name: F.col(f"`{name}`")
    asked = [F.count(F.lit(1)).alias("n")]
    for i, (name, kind) in enumerate(columns.items()):
        asked += [F.approx_count_distinct(c(name), NDV_ERROR).alias(f"d{i}"), F.min(c(name)).alias(f"l{i}"), F.max(c(name)).alias(f"h{i}"), (F.avg(F.length(c(name)) + 3) if kind == "text" else F.lit(9.0)).alias(f"w{i}")]
    row = df.agg(*asked).first()
    n, out = row["n"], {}
    for i, (name, kind) in enumerate(columns.items()):
        s = out[name] = ColumnStats(kind, max(1, min(row[f"d{i}"], n)), row[f"l{i}"], row[f"h{i}"], float(row[f"w{i}"] or 9.0))
        if not n:
            continue
        found = df.groupBy(c(name).alias("v")).count().orderBy(F.desc("count"), "v").limit(MOST_COMMON + 1).collect()
        if len(found) <= MOST_COMMON:
            s.common, s.ndv = {r["v"]: r["count"] for r in found}, len(found)
        else:  # those clearly above the average
            s.common = {r["v"]: r["count"] for r in found[:MOST_COMMON] if r["count"] >= 2 and r["count"] > 1.25 * n / s.ndv}
        rest = n - sum(s.common.values())
        if kind != "text" and rest > 0:
            others = df.filter(~c(name).isin(list(s.common))) if s.common else df
            points = others.agg(F.percentile_approx(c(name), [k / BUCKETS for k in range(BUCKETS + 1)], 10_000)).first()[0]
            each = rest / BUCKETS
            for low, high in zip(points, points[1:], strict=False):
                if s.buckets and s.buckets[-1][0] == low and s.buckets[-1][1] == high:
                    s.buckets[-1] = (low, high, s.buckets[-1][2] + each)
                else:
                    s.buckets.append((low, high, each))
        if order is not None and n > 1:
            s.correlation = neighbours_in_order(df, order, name).first()[0]
    size = int(sum(s.width for s in out.values()) * n)
    return TableStats(n, size, out)
