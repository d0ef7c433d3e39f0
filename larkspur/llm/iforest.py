"""Quality rules: counts over whole texts, and isolation forests on rule statistics.

The counts are exact. Each group of statistics has a forest, grown on a bounded, hash-chosen sample of documents that pass
the base rules, with the usual random splits; small samples for each tree keep junk of a few hundredths of all rows from
hiding itself. A document's score in a group is 2^(-mean path length / expected length); its anomaly is the greatest. Each
group's threshold comes from the scores of all labelled rows: it spares nearly all of those labelled good and, within that,
drops the most labelled bad; it is found on a histogram of fixed size. A group that tells no bad rows has no threshold.

Defined results: a null text has no words and fails the base rules; repeated rows repeat; null labels are ignored and,
without any labels, only the base rules decide; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

WINDOW, SYMBOLS, BINS = 8, b"#*$%&|<>", 1000
#: Each group has a forest and a threshold of its own, so that rare junk of one kind isn't lost among the others' splits.
GROUPS = (("symbol_share", "upper_share", "word_length"), ("same_word_share",), ("dup_line_share", "repeat_share"), ("digit_share", "mark_share"))
STATISTICS = sum(GROUPS, ())
WHITE = bytes([0x20, *range(0x09, 0x0E)])


def repeated(words: list[bytes]) -> int:
    """Words in WINDOW-word windows that occur twice or more. Exact: windows are numbered by doubling, pairs of pairs."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(ids) < WINDOW or len(numbers) == len(ids):
        return 0
    n, step = len(numbers), 1
    if n < 1 << 7:  # eight numbers fit into one
        keys = ids[: len(ids) - 7]
        for i in range(1, 8):
            keys = keys * n + ids[i : len(ids) - 7 + i]
    else:
        while step < WINDOW:
            keys = ids[:-step] * n + ids[step:]
            step *= 2
            if step < WINDOW:
                seen, ids = np.unique(keys, return_inverse=True)
                n = len(seen)
                if n == len(ids):
                    return 0
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def measured(text: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the counts behind the other statistics."""
    words = text.split()  # of bytes: exactly the ASCII white space that separates words
    follow = len(text) - len(text.translate(None, bytes(range(0x80, 0xC0))))
    chars = len(text) - follow - (len(text) - len(text.translate(None, WHITE)))
    lines, dups, full = set(), 0, 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            full += 1
            dups += line in lines
            lines.add(line)
    count = lambda drop: len(text) - len(text.translate(None, drop))
    return (
        len(words), chars, count(SYMBOLS), dups, repeated(words), full, sum(map(operator.eq, words, words[1:])),
        count(bytes(range(65, 91))), count(bytes(range(48, 58))), count(b"!?"),
    )


def rule_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id with the base counts and an array of statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measured(t or b"") for t in batch.column(1).to_pylist()]
            table = np.array(rows, np.int64).reshape(len(rows), 10)
            words, chars, symbols, dups, repeats, lines, same, upper, digits, marks = table.T
            n, c = words + 20.0, chars + 100.0  # shares of short texts are drawn to what is usual
            stats = np.stack([symbols / c, upper / c, (chars + 110.0) / n, same / n, dups / (lines + 3.0), repeats / n, digits / c, marks / n], axis=1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, stats.shape[1]), pa.int32()), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, chars, symbols, dups, repeats)), flat], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "stats"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, stats array<double>"
    counts = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("binary").alias("text")).mapInArrow(run, schema)
    return counts.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def expected_length(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    m = np.maximum(n, 2) - 1.0
    return np.where(n < 2, 0.0, np.where(n == 2, 1.0, 2 * (np.log(m) + 0.5772156649) - 2 * m / np.maximum(n, 1)))


class Forest:
    """Trees in arrays: feature (-1 at leaves), split, left child, and the path length that a leaf adds."""

    def __init__(self, rows: np.ndarray, trees: int = 200, each: int = 64, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.each, self.trees = min(each, max(2, len(rows))), []
        for _ in range(trees if len(rows) else 0):
            some = rows[draw.permutation(len(rows))[: self.each]]
            deepest, feature, split, left, value = int(np.ceil(np.log2(max(2, len(some))))), [], [], [], []
            waiting = [(some, 0)]
            feature.append(-1), split.append(0.0), left.append(0), value.append(0.0)
            at = 0
            while at < len(waiting):
                here, depth = waiting[at]
                low, high = here.min(axis=0), here.max(axis=0)
                able = np.flatnonzero(high > low)
                if depth >= deepest or len(here) < 2 or not len(able):
                    value[at] = depth + float(expected_length(np.array(len(here))))
                else:
                    feature[at] = int(draw.choice(able))
                    split[at] = float(draw.uniform(low[feature[at]], high[feature[at]]))
                    left[at] = len(waiting)
                    less = here[:, feature[at]] < split[at]
                    for part in (here[less], here[~less]):
                        waiting.append((part, depth + 1))
                        feature.append(-1), split.append(0.0), left.append(0), value.append(0.0)
                at += 1
            self.trees.append((np.array(feature), np.array(split), np.array(left), np.array(value), deepest))

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, split, left, value, deepest in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(deepest + 1):
                f = feature[node]
                node = np.where(f < 0, node, left[node] + (rows[every, f] >= split[node]))
            total += value[node]
        return 2.0 ** (-total / max(1, len(self.trees)) / float(expected_length(np.array(self.each))))


def threshold(good: np.ndarray, bad: np.ndarray, spared: float = 0.99) -> float:
    """Score from which documents are dropped, from counts by bin: it keeps at least a share `spared` of the good rows
    and, among such, drops the most bad rows less five times the good ones."""
    lost_good, lost_bad = good[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1]
    gain = np.where(lost_good <= (1 - spared) * good.sum(), lost_bad - 5 * lost_good, -1)
    at = int(np.argmax(gain[::-1]))  # the highest of equally good thresholds
    return (len(good) - 1 - at) / len(good) if gain.max() > 0 else np.inf


def judged(counts: DataFrame, labels: DataFrame, bound: int = 20_000) -> DataFrame:
    """Counts with anomaly score and kept; counts should be a written table. labels: doc_id, quality 0 or 1."""
    spark = counts.sparkSession
    passing = counts.filter(~F.col("base_failed"))
    sample = shared.hashed_share(passing, "doc_id", bound, passing.count()).select("stats").toPandas()["stats"]
    known = np.array(sorted(map(tuple, sample)), float).reshape(len(sample), len(STATISTICS))
    parts = np.split(np.arange(len(STATISTICS)), np.cumsum([len(g) for g in GROUPS])[:-1])
    sent = spark.sparkContext.broadcast([(part, Forest(known[:, part])) for part in parts])  # each of 200 trees of at most 127 nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("stats")
            rows = batch.column(place).flatten().to_numpy().reshape(batch.num_rows, len(STATISTICS))
            scores = np.stack([forest.score(rows[:, part]) if forest.trees else np.zeros(len(rows)) for part, forest in sent.value], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, scores.size + 1, len(GROUPS)), pa.int32()), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != place], lists], names=[*[n for n in batch.schema.names if n != "stats"], "scores"])

    kept_fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema.fields if f.name != "stats")
    scored = shared.written(counts.mapInArrow(run, kept_fields + ", scores array<double>"), "scored")
    marked = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    each = scored.filter(~F.col("base_failed")).join(marked, "doc_id").select("quality", F.posexplode("scores").alias("group", "score"))
    bins = each.groupBy("group", "quality", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin")).count()
    table = np.zeros((len(GROUPS), 2, BINS), np.int64)
    for group, quality, at, n in bins.collect():  # at most 2 * BINS rows a group
        table[group, quality, at] = n
    kept = ~F.col("base_failed")
    for group, (bad, good) in enumerate(table):
        kept &= F.col("scores")[group] < F.lit(float(threshold(good, bad)))
    return scored.withColumns({"anomaly": F.array_max("scores"), "kept": kept}).drop("scores")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = shared.written(rule_counts(shared.table(spark, sf_dir, "documents")), "counts")
    return judged(counts, shared.table(spark, sf_dir, "labels"))
