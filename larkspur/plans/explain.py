"""EXPLAIN ANALYZE: runs a query and reads the metrics of Spark's final physical plan."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame

SHOWN = ("numOutputRows", "spillSize", "peakMemory", "shuffleBytesWritten", "dataSize", "scanTime", "sortTime", "buildTime")


def seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def metrics_of(node) -> dict[str, int]:
    found, it = {}, node.metrics().iterator()
    while it.hasNext():
        pair = it.next()
        if pair._1() in SHOWN and (value := pair._2().value()) > 0:
            found[pair._1()] = value
    return found


def walk(node, depth: int = 0) -> list[tuple[int, str, dict[str, int]]]:
    """(depth, description, metrics) of every operator, through adaptive stages."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return walk(node.finalPhysicalPlan(), depth)
    if name.endswith("QueryStageExec"):
        return walk(node.plan(), depth)
    if name in ("WholeStageCodegenExec", "InputAdapter"):
        return [x for c in seq(node.children()) for x in walk(c, depth)]
    text = node.simpleStringWithNodeId() if hasattr(node, "simpleStringWithNodeId") else node.nodeName()
    return [(depth, text, metrics_of(node)), *(x for c in seq(node.children()) for x in walk(c, depth + 1))]


def executed(df: DataFrame) -> tuple[int, float, list[str]]:
    """Number of rows, which stay on the executors, seconds, and the annotated plan; falls back to the plan's text where
    metrics cannot be read."""
    began = time.perf_counter()
    query = df._jdf.queryExecution()
    rows = query.toRdd().count()
    seconds = time.perf_counter() - began
    try:
        lines = []
        for depth, text, found in walk(query.executedPlan()):
            notes = " ".join(f"{'actual' if k == 'numOutputRows' else k}={v}" for k, v in found.items())
            lines.append(f"{'  ' * depth}{text[:160]}{'  [' + notes + ']' if notes else ''}")
    except Exception:  # internals differ between versions
        lines = query.executedPlan().toString().splitlines()
    return rows, seconds, lines
