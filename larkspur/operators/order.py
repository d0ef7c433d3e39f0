"""Order statistics without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbours_in_order(df: DataFrame, order: str, value: str) -> DataFrame:
    """One row, `correlation`: the share of adjacent rows, in the order of a column, whose values do not fall."""
    rows = df.select(F.col(order).alias("o"), F.col(value).alias("v")).repartitionByRange("o").withColumn("part", F.spark_partition_id())
    before = F.lag("v").over(Window.partitionBy("part").orderBy("o"))
    within = rows.withColumn("before", before).groupBy("part").agg(
        F.count(F.when(F.col("v") >= F.col("before"), 1)).alias("up"), F.count("before").alias("pairs"),
        F.min_by("v", "o").alias("first"), F.max_by("v", "o").alias("last"),
    )
    # from here on one row per partition
    ends = within.withColumn("previous", F.lag("last").over(Window.orderBy("part")))
    up = F.sum(F.col("up") + F.coalesce((F.col("first") >= F.col("previous")).cast("long"), F.lit(0)))
    pairs = F.sum(F.col("pairs") + F.col("previous").isNotNull().cast("long"))
    return ends.agg(F.round(up / pairs, 6).alias("correlation"))


def pairs_below(left: DataFrame, low: Column, right: DataFrame, high: Column) -> DataFrame:
    """n: how many pairs of a row of left and one of right have low < high. Rows are counted by value, and running counts
    within range partitions and over one row per partition give the sum; no pair is built."""
    values = left.select(low.alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(right.select(high.alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = values.filter("v is not null").groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    spread = counts.repartitionByRange("v").withColumn("part", F.spark_partition_id())
    before = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    parts = spread.withColumn("below", F.coalesce(F.sum("a").over(before), F.lit(0))).groupBy("part").agg(F.sum(F.col("b") * F.col("below")).alias("inside"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("a").over(earlier), F.lit(0))).agg(F.coalesce(F.sum(F.col("inside") + F.col("b") * F.col("base")), F.lit(0)).cast("bigint").alias("n"))
