"""Connected components of links by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

ROWS_A_TASK = 50_000


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in links (a, b: long; any order, loops allowed).

    Each turn is two aggregations with partial minima and two joins; a hub's neighbours are never gathered, and Spark may
    split its rows in the joins. Turns go on until every node points at its component's least, about the logarithm of the
    longest path of them; each turn's table replaces the one before, has no more rows, and is written by as many tasks as
    those rows need (`ROWS_A_TASK`), as each file of a table costs about as much as its rows. An empty input gives an empty
    result.
    """
    spark = links.sparkSession
    edges, path = shared.written_at(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        tasks = edges.count() // ROWS_A_TASK + 1
        # large star: every larger neighbour points at the smallest of the closed neighbourhood
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: smaller neighbours, and the node itself, point at the smallest of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, there = shared.written_at(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks), "edges")
        # done when every node points at one that points nowhere
        done = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() and after.groupBy("u").count().filter("count > 1").isEmpty()
        shared.remove(spark, path)
        edges, path = after, there
        if done:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
