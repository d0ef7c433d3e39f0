"""Packing documents into sequences by cutting-stock column generation.

A document is cut into full sequences and a rest. Rests are grouped by width: their length up to `fine` ids, longer ones
rounded up to the next multiple of `step`. The linear program over that histogram (its rows are bounded by the length of a
sequence, whatever the input's size) is solved by column generation: a knapsack dynamic program prices new patterns until
the plan is within `gap` of the bound. Rounded-down patterns and a first-fit plan for what remains make a table of slots.
Documents get ranks within their width from prefix sums over the writing tasks, and a rank gives pattern, copy of the
pattern and slot. Rests alone are shuffled, by the sequence that they go to.

Defined results: a null text is empty and has only the end id; every row is a document of its own, so repeated rows are
packed again; texts of any length are cut, never shortened; documents of one width are packed in no particular order; an
empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

MB_OF_TEXT = 8


def priced(sizes: np.ndarray, value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable pattern in `room` units, as how often it takes each of the (rising) sizes."""
    # an item that no smaller one outdoes is all that a best pattern needs
    able = np.flatnonzero(value > np.r_[0.0, np.maximum.accumulate(np.maximum(value, 0))[:-1]])
    sizes_, value_ = sizes[able], value[able]
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    if len(able):
        fitting = np.searchsorted(sizes_, np.arange(room + 1), "right")
        for r in range(int(sizes_[0]), room + 1):
            k = fitting[r]
            sums = best[r - sizes_[:k]] + value_[:k]
            i = int(sums.argmax())
            if sums[i] > best[r - 1]:
                best[r], choice[r] = sums[i], i
            else:
                best[r] = best[r - 1]
    pattern, r = np.zeros(len(sizes), int), room
    while r > 0:
        if choice[r] >= 0:
            pattern[able[choice[r]]] += 1
            r -= sizes_[choice[r]]
        else:
            r -= 1
    return float(best[room]), pattern


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row exchanges, in plain array operations: a BLAS thread pool can hang in a process that forked
    a JVM."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for i in range(n):
        best = i + int(np.argmax(np.abs(both[i:, i])))
        both[[i, best]] = both[[best, i]]
        both[i] /= both[i, i]
        factors = both[:, i].copy()
        factors[i] = 0
        both -= factors[:, None] * both[i]
    return both[:, n:]


def greedy_basis(sizes: np.ndarray, need: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """A first basis: the largest sizes that fit, used until one of them is spent; triangular in that order."""
    left, m = need.copy(), len(sizes)
    patterns, used, open_ = np.zeros((m, m)), np.zeros(m), np.ones(m, bool)
    for t in range(m):
        free = room
        for i in np.flatnonzero(open_)[::-1]:
            n = min(free // sizes[i], max(1, int(left[i])))
            patterns[i, t], free = n, free - n * sizes[i]
        held = patterns[:, t] > 0
        spent = np.flatnonzero(held)[np.argmin(left[held] / patterns[held, t])]
        used[t] = left[spent] / patterns[spent, t]
        left = np.maximum(left - used[t] * patterns[:, t], 0)
        left[spent], open_[spent] = 0, False
    return patterns, used


def generated_patterns(demand: np.ndarray, room: int, gap: float = 1e-3) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the linear program uses them; demand[w] counts items of w units.

    Ends once the total is within one sequence, or a relative gap, of a lower bound (of the dual, or of what the items
    fill), or when as many columns as there are sizes have not lowered it: any basis on the way is a feasible plan.
    """
    sizes = np.flatnonzero(demand)
    if not len(sizes):
        return []
    need = demand[sizes].astype(float)
    patterns, used = greedy_basis(sizes, need, room)
    inverse, bound = inverted(patterns), float((need * sizes).sum()) / room
    lowest, idle, turn = np.inf, 0, 0
    while True:
        dual = inverse.sum(axis=0)
        worth, pattern = priced(sizes, np.maximum(dual, 0), room)
        total, bound = used.sum(), max(bound, (dual * need).sum() / max(worth, 1e-9))
        idle = 0 if total < lowest - 1e-9 else idle + 1
        lowest = min(lowest, total)
        if worth <= 1 + 1e-9 or total - bound <= max(1, gap * total) or idle > len(sizes):
            break
        column = pattern.astype(float)
        move = (inverse * column).sum(axis=1)
        able = move > 1e-9
        leaving = int(np.argmin(np.where(able, used / np.where(able, move, 1), np.inf)))
        amount = used[leaving] / move[leaving]
        used = np.maximum(used - amount * move, 0)
        used[leaving] = amount
        patterns[:, leaving] = column
        row = inverse[leaving] / move[leaving]
        inverse -= np.outer(move, row)
        inverse[leaving] = row
        turn += 1
        if turn % 500 == 0:
            inverse = inverted(patterns)
    out = []
    for j in np.flatnonzero(used > 1e-9):
        whole = np.zeros(room + 1, int)
        whole[sizes] = np.round(patterns[:, j]).astype(int)
        out.append((whole, float(used[j])))
    return out


def fitted(left: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns that hold all items: the largest that fits, again and again; repeated while the same pattern still fits."""
    out, left = [], left.copy()
    while left.any():
        pattern, free, w = np.zeros(room + 1, int), room, room
        for w in np.flatnonzero(left)[::-1]:
            if w <= free:
                pattern[w] = min(int(left[w]), free // w)
                free -= pattern[w] * w
        held = pattern > 0
        times = int((left[held] // pattern[held]).min())
        out.append((pattern, times))
        left -= pattern * times
    return out


def plan(demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of patterns that hold all items: the program's, rounded down, then best fit for what is left; or best
    fit alone, where that takes no more sequences."""
    simple = fitted(demand, room)
    if sum(n for _, n in simple) <= -(-int((demand * np.arange(room + 1)).sum()) // room):
        return simple  # no plan has fewer
    left, out = demand.copy(), []
    for pattern, used in generated_patterns(demand, room):
        times = int(used + 1e-9)
        held = pattern > 0
        times = min(times, int((left[held] // pattern[held]).min()))
        if times:
            out.append((pattern, times))
            left -= pattern * times
    out += fitted(left, room)
    return min(simple, out, key=lambda p: sum(n for _, n in p))


def parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First rows and rows past the last of parts of as many texts as MB_OF_TEXT holds, at least one."""
    ends, at = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0)), dtype=np.int64), 0
    while at < len(ends):
        begin = ends[at - 1] if at else 0
        past = max(at + 1, int(np.searchsorted(ends, begin + MB_OF_TEXT * 1_000_000, "right")))
        yield at, past
        at = past


def encoded(docs: DataFrame, tokenizer: str, end_id: int, length: int, fine: int, step: int, text: str) -> DataFrame:
    """Each document's ids, task, width of its rest, number among its task's documents of that width, and full sequences
    before it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .encoder import encoder

        encode, end, task = encoder(tokenizer).encode_each, array("I", [end_id]).tobytes(), TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        full = 0
        for whole in batches:
            for at, past in parts(whole.column(1)):
                batch = whole.slice(at, past - at)
                ids = encode(batch.column(1), end)
                tokens = pc.divide(pc.binary_length(ids), 4).cast(pa.int64())
                ranks, classes, before = [], [], []
                for n in tokens.to_pylist():
                    kind = n % length if n % length <= fine else min(length, -(-(n % length) // step) * step)
                    classes.append(kind)
                    ranks.append(seen[kind])
                    before.append(full)
                    seen[kind] += 1
                    full += n // length
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), ids, tokens, pa.array([task] * len(ids), pa.int64()), pa.array(classes, pa.int64()), pa.array(ranks, pa.int64()), pa.array(before, pa.int64())],
                    ["doc_id", "ids", "doc_tokens", "task", "class", "rank", "full_before"],
                )

    schema = "doc_id long, ids binary, doc_tokens long, task long, class long, rank long, full_before long"
    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, schema)


def packed(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, length: int = 2048, fine: int = 128, step: int = 8, text: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    spark, room = docs.sparkSession, length
    all_ids = shared.written(encoded(docs, tokenizer, end_id, length, fine, step, text), "encoded", compression="zstd")
    counts = all_ids.filter("class > 0").groupBy("class", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = shared.written(counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "bases")
    demand = np.zeros(room + 1, int)
    for kind, n in bases.groupBy("class").agg(F.sum("n")).collect():  # at most `room` rows
        demand[kind] = n

    slots, first, sequence = [], np.zeros(room + 1, int), 0
    for pattern, times in plan(demand, room):
        place = 0
        for kind in np.flatnonzero(pattern)[::-1]:
            n = int(pattern[kind])
            slots.append((int(kind), int(first[kind]), int(first[kind]) + n * times, n, place, sequence))
            first[kind], place = first[kind] + n * times, place + n
        sequence += times
    slots = spark.createDataFrame(slots, "class long, first long, past long, each long, place long, sequence long")

    done = F.col("doc_tokens").cast("int").cast("long")
    whole = F.floor(done / length)
    rests = all_ids.filter("class > 0").join(bases.select("class", "task", "base"), ["class", "task"]).withColumn("rank", F.col("rank") + F.col("base"))
    rests = rests.join(F.broadcast(slots), (rests["class"] == slots["class"]) & (rests["rank"] >= slots["first"]) & (rests["rank"] < slots["past"])).drop(slots["class"])
    nth = F.col("rank") - F.col("first")
    start = whole * length
    rests = rests.select(
        "doc_id", start.alias("start"), (done - start).alias("length"), F.expr(f"substring(ids, int(floor(doc_tokens / {length}) * {length * 4} + 1))").alias("ids"), "doc_tokens",
        (F.col("sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"), (F.col("place") + nth % F.col("each")).alias("slot"),
    )
    running = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    rests = rests.withColumn("offset", F.coalesce(F.sum("length").over(running), F.lit(0)).cast("long")).drop("slot")
    full = all_ids.filter(F.col("doc_tokens") >= length).select("*", F.explode(F.sequence(F.lit(0), (whole - 1).cast("int"))).alias("i"))
    full = full.select(
        "doc_id", (F.col("i").cast("long") * length).alias("start"), F.lit(length).cast("long").alias("length"), F.expr(f"substring(ids, i * {length * 4} + 1, {length * 4})").alias("ids"), "doc_tokens",
        # unique without another prefix sum: the task's number above, the number within the task below
        (F.lit(sequence) + F.col("task") * (1 << 36) + F.col("full_before") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return full.unionByName(rests)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packed(shared.table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
