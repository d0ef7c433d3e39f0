"""Embedding near-dedup: a subspace pigeonhole join.

Unit vectors are rotated by a fixed random rotation and split into blocks. If two unit vectors have cosine >= t, their
squared distance is at most 2 - 2t, so in one block at least it is at most that block's share of the budget, in proportion
to its dimensions. Each block is range-joined over a grid: as many cells as the input needs for cells of `cell_size`
vectors, cut at quantiles of the block's coordinates (of a bounded sample), those that vary most first. A vector is at home
in one cell and probes the cells with higher numbers that its ball reaches: those to which the squared distances along all
cut coordinates sum to no more than the budget. So each pair meets once in a block; it counts in the first block within
budget, and is verified by the cosine of the full vectors in double precision. Cells of more than `part_size` vectors are
dealt into parts. Tasks stream: a part's home vectors stay in memory, probes pass by in batches, and what leaves is counts
and a spanning forest of the links, never all pairs.

On vectors without structure a ball of cosine 0.9 reaches most cells of a block, so the work then is close to comparing
every block of every pair, spread evenly over tasks; on clustered vectors cells far away are never visited.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different length never link; equal vectors form one class that is compared once; a null vec_id links with nothing;
repeated rows count as other vectors; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .components import components

BLOCK, SLACK, TILE = 16, 1e-6, 1024


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    """A random orthonormal matrix by Gram-Schmidt, the same in every task; plain array operations."""
    m = np.random.default_rng(seed + dims).standard_normal((dims, dims))
    for i in range(dims):
        for _ in range(2):
            m[i] -= (m[:i] * (m[:i] * m[i]).sum(axis=1)[:, None]).sum(axis=0)
        m[i] /= np.sqrt((m[i] ** 2).sum())
    return m


def units(raw: list[bytes], dims: int, kind: str) -> np.ndarray:
    """Unit vectors from the bytes of vectors; scaled by the largest component first, so that no square overflows."""
    rows = np.frombuffer(b"".join(raw), kind).reshape(-1, dims).astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def rotated(rows: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Without BLAS, whose threads can hang in a process that forked a JVM; the same sums wherever a row is rotated."""
    out = np.zeros((len(rows), len(turn)))
    for i in range(rows.shape[1]):
        out += rows[:, i, None] * turn[:, i]
    return out


def packed_vectors(vectors: DataFrame, key: str, column: str, kind: str) -> DataFrame:
    """key, dims and the vector's bytes, null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, data = [], []
            for v in batch.column(1).to_pylist():
                good = bool(v) and None not in v
                x = np.array(v if good else [], kind)
                good = good and bool(np.isfinite(x).all()) and bool(x.any())
                dims.append(len(x) if good else None)
                data.append((x + x.dtype.type(0)).tobytes() if good else None)  # adding 0 makes -0 equal 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], ["vec_id", "dims", "data"])

    return vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("v")).mapInArrow(run, "vec_id long, dims int, data binary")


def blocks_of(dims: int) -> list[tuple[int, int]]:
    return [(i, min(i + BLOCK, dims)) for i in range(0, dims, BLOCK)]


def grids(sample: np.ndarray, bits: int) -> list[list[tuple[int, np.ndarray]]]:
    """For each block the coordinates that are cut, with their cuts: `bits` halvings go round the block's coordinates,
    from the one that varies most; a coordinate with n of them has 2^n intervals of equal share in the sample."""
    out = []
    for low, high in blocks_of(sample.shape[1]):
        order = low + np.argsort(-sample[:, low:high].var(axis=0), kind="stable")
        share = [bits // len(order) + (j < bits % len(order)) for j in range(len(order))]
        out.append([(int(c), np.quantile(sample[:, c], np.arange(1, 1 << n) / (1 << n))) for c, n in zip(order, share, strict=True) if n])
    return out


def homes(x: np.ndarray, grid: list[tuple[int, np.ndarray]]) -> np.ndarray:
    cell = np.zeros(len(x), np.int64)
    for c, cuts in grid:
        cell = cell * (len(cuts) + 1) + np.searchsorted(cuts, x[:, c], "right")
    return cell


def reached(x: np.ndarray, grid: list[tuple[int, np.ndarray]], budget: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and cell of every cell above its own that a row's ball reaches, found coordinate by coordinate."""
    who, cell, own, spent = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.zeros(len(x))
    for c, cuts in grid:
        at, edges, parts = np.searchsorted(cuts, x[:, c], "right"), np.r_[-np.inf, cuts, np.inf], []
        own = own * (len(cuts) + 1) + at
        for i in range(len(cuts) + 1):
            away = np.maximum(np.maximum(edges[i] - x[:, c], x[:, c] - edges[i + 1]), 0) ** 2
            total, to = spent + away[who], cell * (len(cuts) + 1) + i
            keep = (total <= budget) & (to >= own[who])  # what lies below its own cell so far stays below
            parts.append((who[keep], to[keep], total[keep]))
        who, cell, spent = (np.concatenate(z) for z in zip(*parts, strict=True))
    above = cell > own[who]
    return who[above], cell[above]


def placed(classes: DataFrame, cuts: dict[int, list], kind: str, budget: float, probes: bool) -> DataFrame:
    """The home cell of every vector in each block and, if wanted, the cells that it probes; with the vector then."""
    sent = classes.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                all_dims = batch.column(1).to_numpy()
                for dims in np.unique(all_dims):
                    rows = np.flatnonzero(all_dims == dims)
                    ids, n, data = (batch.column(i).take(pa.array(rows)) for i in (0, 3, 2))
                    x = rotated(units(data.to_pylist(), int(dims), kind), rotation(int(dims)))
                    for b, grid in enumerate(sent.value[int(dims)]):
                        low, high = blocks_of(int(dims))[b]
                        take, cells = np.arange(len(x)), homes(x, grid)
                        if probes:
                            who, to = reached(x, grid, budget * (high - low) / dims + SLACK)
                            take, cells = np.r_[take, who], np.r_[cells, to]
                        first = [pa.array(np.full(len(take), dims, np.int32)), pa.array(np.full(len(take), b, np.int32)), pa.array(cells)]
                        if not probes:
                            yield pa.RecordBatch.from_arrays(first, ["dims", "block", "cell"])
                            continue
                        home, index = pa.array(np.arange(len(take)) < len(x)), pa.array(take)
                        yield pa.RecordBatch.from_arrays([*first, home, ids.take(index), n.take(index), data.take(index)], ["dims", "block", "cell", "home", "id", "n", "data"])

    schema = "dims int, block int, cell long" + ", home boolean, id long, n long, data binary" * probes
    return classes.select("id", "dims", "data", "n").mapInArrow(run, schema)


class Side:
    """Vectors of one part, or of a batch of probes."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, rows: np.ndarray, turn: np.ndarray, low: int, high: int):
        self.ids, self.n, self.rows, self.spun = ids, n, rows, rotated(rows, turn)
        block = self.spun[:, low:high].astype(np.float32)
        square, ones = (block * block).sum(axis=1, keepdims=True), np.ones((len(block), 1), np.float32)
        # the product of a left and a right row is their squared distance
        self.left, self.right = np.hstack([block, square, ones]), np.hstack([-2 * block, ones, square])
        self.found = np.zeros(len(ids), np.int64)

    def counts(self) -> Iterator[pa.RecordBatch]:
        hit = np.flatnonzero(self.found)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[hit]), pa.nulls(len(hit), pa.int64()), pa.array(self.found[hit])], ["a", "b", "found"])


def forest(u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links that span the components of links (u, v): labels fall to the least neighbour until nothing changes."""
    nodes, flat = np.unique(np.r_[u, v], return_inverse=True)
    p, q, label = flat[: len(u)], flat[len(u) :], np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, p, label[q])
        np.minimum.at(label, q, label[p])
        label = label[label]
        if (label == before).all():
            break
    own = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]]), pa.nulls(len(own), pa.int64())], ["a", "b", "found"])


def joined(rows: DataFrame, threshold: float, kind: str) -> DataFrame:
    """Streams parts of cells, home vectors first: the copies that link with a vector (found, to be summed by a), and links
    (a, b) that span the same components as all links found. rows: dims, block, cell, part, home, id, n, data."""
    budget = 2 - 2 * threshold

    def compared(x: Side, y: Side, block: int, starts: list[int], limits: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links between two sides, or within one, each pair once; counts them on both."""
        for i in range(0, len(x.ids), TILE):
            for j in range(i if x is y else 0, len(y.ids), TILE):
                near = x.left[i : i + TILE] @ y.right[j : j + TILE].T <= np.float32(limits[block] + 1e-5)
                hits, wide, links = np.flatnonzero(near.ravel()), near.shape[1], []
                for k in range(0, len(hits), 50_000):
                    a, b = np.divmod(hits[k : k + 50_000], wide)
                    a, b = a + i, b + j
                    if x is y:
                        a, b = a[a < b], b[a < b]
                    if not len(a):
                        continue
                    by_block = np.add.reduceat((x.spun[a] - y.spun[b]) ** 2, starts, axis=1) <= limits
                    first = by_block[:, block] & (by_block.argmax(axis=1) == block)
                    a, b = a[first], b[first]
                    close = (x.rows[a] * y.rows[b]).sum(axis=1) >= threshold
                    links.append((a[close], b[close]))
                if links and any(len(a) for a, _ in links):
                    a, b = (np.concatenate(z) for z in zip(*links, strict=True))
                    np.add.at(x.found, a, y.n[b])
                    np.add.at(y.found, b, x.n[a])
                    yield from forest(x.ids[a], y.ids[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, side, how = None, [], None, None

        def ready() -> Iterator[pa.RecordBatch]:
            """The part's home vectors are complete: they are compared with each other."""
            nonlocal side
            if key is not None and side is None:
                side = Side(*(np.concatenate(z) for z in zip(*held, strict=True)), *how[:3]) if held else Side(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, key[0])), *how[:3])
                held.clear()
                yield from compared(side, side, key[1], *how[3:])

        for whole in batches:
            column = lambda c: whole.column(whole.schema.get_field_index(c))  # noqa: B023, E731
            is_home = column("home").to_numpy(zero_copy_only=False)
            keys = np.stack([*(column(c).to_numpy().astype(np.int64) for c in ("dims", "block", "cell", "part")), is_home], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), whole.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                now = tuple(keys[s, :4].tolist())
                if now != key:
                    yield from ready()
                    if side is not None:
                        yield from side.counts()
                    key, side = now, None
                    spans = blocks_of(now[0])
                    limits = np.array([budget * (h - l) / now[0] + SLACK for l, h in spans])
                    how = (rotation(now[0]), *spans[now[1]], [l for l, _ in spans], limits)
                part = (column("id").to_numpy()[s:e], column("n").to_numpy()[s:e], units(column("data").slice(s, e - s).to_pylist(), now[0], kind))
                if is_home[s]:
                    held.append(part)
                    continue
                yield from ready()
                for i in range(0, e - s, 4 * TILE):
                    probes = Side(*(z[i : i + 4 * TILE] for z in part), *how[:3])
                    yield from compared(side, probes, now[1], *how[3:])
                    yield from probes.counts()
        yield from ready()
        if side is not None:
            yield from side.counts()

    return rows.mapInArrow(run, "a long, b long, found long")


def similar(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = 0.9, sample: int = 4096, cell_size: int = 8_192, part_size: int = 8_192) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row. `sample` vectors, chosen by hash, place the cuts of the cells."""
    kind = "<f4" if vectors.schema[column].dataType.elementType.typeName() == "float" else "<f8"
    rows = shared.written(packed_vectors(vectors, key, column, kind), "vectors")
    good = rows.filter("data is not null and vec_id is not null")
    classes = shared.written(good.groupBy("dims", "data").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).select("id", "dims", "data", "n"), "classes")
    cuts: dict[int, list] = {}
    for dims, total in classes.groupBy("dims").count().collect():  # one row for each length of vectors
        some = shared.hashed_share(classes.filter(F.col("dims") == dims), "id", sample, total).select("data").collect()
        spun = rotated(units(sorted(bytes(r["data"]) for r in some), dims, kind), rotation(dims)) if some else np.zeros((1, dims))
        cuts[dims] = grids(spun, max(0, -(-total // cell_size) - 1).bit_length())
    budget = 2 - 2 * threshold
    sizes = placed(classes, cuts, kind, budget, False).groupBy("dims", "block", "cell").agg(F.ceil(F.count("*") / part_size).cast("int").alias("parts"))
    cells = placed(classes, cuts, kind, budget, True).join(shared.written(sizes, "cells"), ["dims", "block", "cell"])
    # a home vector goes to its part of the cell, and as a probe to the parts after it; another cell's probe to every part
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = cells.withColumn("own", own).withColumn("part", F.explode(F.sequence(F.when(F.col("home"), F.col("own")).otherwise(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("home", F.col("home") & (F.col("part") == F.col("own")))
    ordered = dealt.repartition("dims", "block", "cell", "part").sortWithinPartitions("dims", "block", "cell", "part", F.desc("home"))
    found = shared.written(joined(ordered.select("dims", "block", "cell", "part", "home", "id", "n", "data"), threshold, kind), "found")
    groups = components(found.filter("b is not null").select("a", "b"))
    counts = found.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("found").alias("found"))
    by_class = classes.join(counts, "id", "left").join(groups, F.col("id") == F.col("node"), "left")
    by_class = by_class.select("dims", "data", (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    keyed = rows.withColumn("linkable", F.when(F.col("vec_id").isNotNull(), F.col("data")))
    out = keyed.join(by_class.withColumnRenamed("data", "linkable"), ["dims", "linkable"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(shared.table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
edges AS (SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) AND list_cosine_similarity(p.e, q.e) >= 0.9),
counts AS (SELECT a, count(*) AS n FROM edges GROUP BY a),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, edges.b FROM reach JOIN edges ON reach.other = edges.a)
SELECT reach.vec_id, coalesce(any_value(counts.n), 0) AS n_links, min(other) AS component_id, reach.vec_id = min(other) AS kept
FROM reach LEFT JOIN counts ON counts.a = reach.vec_id GROUP BY reach.vec_id
"""
