"""Inner and cross joins with a choice of strategy, and the check of size that a broadcast needs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HINTS = {"hash": "shuffle_hash", "merge": "merge", "nestloop": "shuffle_replicate_nl"}
BROADCAST_BYTES = 64 << 20
#: Rows of a join that a task should make, how many times the rows of its inputs make a join's rows many, and the most tasks
#: (beyond 84 billion rows they make more rows each).
ROWS_A_TASK, MANY, MOST_TASKS = 4 << 20, 2, 20_000
#: Expected bytes of a side that a dealt join sends to every executor, and parts a task that it cuts a larger one's keys into.
DEALT_BYTES, PARTS = 16 << 20, 8


def planned_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a plan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_enough(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if Spark's estimate of its size allows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if planned_bytes(df) <= most else df


def inner(left: DataFrame, right: DataFrame, on: Column | None, strategy: str | None = None) -> DataFrame:
    """An inner join; a cross product without a condition. strategy: hash, merge, nestloop, lookup (broadcast if small)."""
    if strategy == "lookup":
        right = small_enough(right)
    elif strategy in HINTS:
        right = right.hint(HINTS[strategy])
    return left.crossJoin(right) if on is None else left.join(right, on, "inner")


def counted(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, int]]:
    """Rows without NULL in the columns, and the distinct values of each (HyperLogLog), in one pass over these columns."""
    there = [F.col(f"`{c}`") for c in columns]
    for c in there:
        df = df.filter(c.isNotNull())
    n, *distinct = df.agg(F.count(F.lit(1)), *[F.approx_count_distinct(c) for c in there]).first()
    return n, {c: max(1, min(d, n)) for c, d in zip(columns, distinct, strict=True)}


def many(rows: float, left: float, right: float) -> bool:
    """Whether a join makes so many rows of its inputs that neither their bytes nor their keys tell how many tasks it needs."""
    return rows > ROWS_A_TASK and rows > MANY * (left + right)


def dealt(left: DataFrame, right: DataFrame, on: Column, keys: list[tuple[str, str]], rows: float, groups: float, sizes: tuple[float, float], widths: tuple[int, int], strategy: str | None = None) -> DataFrame:
    """An inner equi-join of many rows (see many) in tasks of about ROWS_A_TASK of them, though a key's rows are more.

    rows and groups are the expected rows and keys of the join, sizes and widths the rows of either side and their bytes.
    A small side goes to every executor, and the other is dealt evenly. Otherwise each side's rows are dealt to parts, every
    pair of a left and a right part meets once, and the pairs of a key are spread by hash; strategy holds there. keys are all
    columns that the condition equates, in its order, without which Spark would deal the rows again by its own count of tasks
    (where that is higher, it does anyway).
    """
    tasks = min(MOST_TASKS, math.ceil(rows / ROWS_A_TASK))
    bytes_ = [n * w for n, w in zip(sizes, widths, strict=True)]
    if strategy in (None, "lookup") and min(bytes_) <= DEALT_BYTES:
        if bytes_[1] <= bytes_[0]:
            return left.repartition(tasks).join(F.broadcast(right), on, "inner")
        return F.broadcast(left).join(right.repartition(tasks), on, "inner")
    cells = max(1, PARTS * tasks / groups)  # of a key; a times b, so that few rows are copied
    a = min(math.ceil(cells), max(1, round(math.sqrt(cells * sizes[0] / max(1, sizes[1])))))
    b = math.ceil(cells / a)
    sides = []
    for df, own, parts, other, copies, columns in ((left, "_a", a, "_b", b, [x for x, _ in keys]), (right, "_d", b, "_c", a, [y for _, y in keys])):
        # by the partition, which a row keeps when its task runs again, and which rows alike do not share
        df = df.repartition(parts * math.ceil(tasks / parts)).withColumn(own, F.spark_partition_id() % parts) if parts > 1 else df.withColumn(own, F.lit(0))
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        sides.append(df.repartition(tasks, *[F.col(f"`{c}`") for c in columns], *(F.col(c) for c in sorted((own, other)))))
    out = sides[0].join(sides[1].hint(HINTS.get(strategy, HINTS["hash"])), on & (F.col("_a") == F.col("_c")) & (F.col("_b") == F.col("_d")), "inner")
    return out.drop("_a", "_b", "_c", "_d")


def width(types: list[str]) -> int:
    """Bytes of a row in memory by its columns' types, texts as of 24."""
    return 16 + sum(32 if t in ("text", "string") else 8 for t in types)


def inner_on(left: DataFrame, right: DataFrame, x: str, y: str) -> DataFrame:
    """An inner join of two frames on one column of each; one of many rows is dealt by them."""
    on = F.col(x) == F.col(y)
    (n, dx), (m, dy) = counted(left, [x]), counted(right, [y])
    rows = n * m / max(dx[x], dy[y])
    if not many(rows, n, m):
        return inner(left, right, on)
    return dealt(left, right, on, [(x, y)], rows, min(dx[x], dy[y]), (n, m), tuple(width([t for _, t in df.dtypes]) for df in (left, right)))
