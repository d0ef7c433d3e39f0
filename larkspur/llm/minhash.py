"""MinHash near-dedup with sequential Bayesian verification.

Documents with equal shingle sets form a class, found by aggregation over a hash of the set; a number of its own stands for
it, and classes that share a doc_id are linked. Signatures are cut into bands; representatives that share a band are candidates. Three passes verify them:

1. each representative with the smallest one that it shares a band with;
2. in buckets whose members are then in several components, each member outside of the main component with its likeliest
   partner from another component;
3. in buckets that still hold several components, all pairs of different components, each in the first band it shares;
   a bucket of more than LARGE members brings its shingle sets along and verifies at once, so that what leaves it is at
   most one link for each component that it joins to another.

In passes 2 and 3 the members of a bucket's main component are dealt into parts of bounded size, the others into chunks of
that size, and a task for each chunk and part, and each two chunks, holds one chunk and streams the other, comparing arrays
of signatures, so that a group's pairs are never emitted: those within one component need no look. Signatures are compared batch by batch, and a pair is dropped once the posterior probability
(uniform prior) that its similarity reaches the threshold is below the chosen miss probability. Survivors are verified on
full shingle sets.

Defined results: a null text and one without words have no shingles and link with nothing; a text of fewer than `width`
words has one shingle, the whole; texts of any length give all their shingles; rows that share a doc_id are one node,
whether their texts are equal or not: what links with one of them links with all; null doc_ids link with nothing; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .components import components

WIDTH, BANDS, ROWS = 5, 32, 4
HASHES, BATCH = BANDS * ROWS, 32
PERCENT, MISS = 75, 1e-6
LARGE = 32
MIX1, MIX2, STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def finished(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: shifts and odd multiplications."""
    x = (x ^ (x >> np.uint64(33))) * MIX1
    x = (x ^ (x >> np.uint64(33))) * MIX2
    return x ^ (x >> np.uint64(33))


def multipliers() -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, HASHES + 1, dtype=np.uint64)
    return finished(i * STEP) | np.uint64(1), finished(i * STEP + MIX1)


class WordHashes(dict):
    """64-bit hashes of words, a bounded number of them remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(WIDTH, len(ids))
    total = np.full(len(ids) - n + 1, n, np.uint64)
    for i in range(n):
        total = finished(total * STEP + ids[i : len(ids) - n + 1 + i])
    return np.unique(total)


def signature(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """HASHES minima of 32-bit values."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(sets), 4096):
        part = sets[i : i + 4096]
        out = np.minimum(out, ((part[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)).min(axis=1))
    return out.astype(np.uint32)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hash (of the whole set) and signature, from columns doc_id, text (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.release()
        hashes, (a, b) = WordHashes(), multipliers()
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch, sizes, keys, rows = whole.slice(at, 2000), [], [], []
                for t in batch.column(1).to_pylist():
                    s = shingles(t, hashes)
                    sizes.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    rows.append(signature(s, a, b).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.binary())], ["doc_id", "n_shingles", "set_hash", "signature"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, signature binary")


def least_matches() -> list[int]:
    """For each number of compared hashes (BATCH, 2 BATCH, ...), the fewest matches that are not pruned.

    With a uniform prior and m matches of k, P(similarity >= t) is P(Binomial(k + 1, t) <= m).
    """
    t, out = PERCENT / 100, []
    for k in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below < MISS:
            m += 1
            below += math.comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
        out.append(m)
    return out


def likely(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which rows of two arrays of signatures survive sequential verification."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), int)
    for i, least in enumerate(least_matches()):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches = matches + (left[alive, part] == right[alive, part]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive


def close(x: bytes, y: bytes) -> bool:
    """Whether two sets, as bytes, are similar enough: 100 * intersection >= PERCENT * union."""
    left, right = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * both >= PERCENT * (len(left) + len(right) - both)


def survivors(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) that survive."""
    sig = signatures.select("num", "signature")
    both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, HASHES) for i in (2, 3))
                keep = pa.array(likely(left, right))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """num and the set's bytes of the wanted classes (num, doc_id of a member, set_hash); the texts are shuffled once. Of
    rows that share the doc_id, one whose set has the hash is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, done = WordHashes(), set()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch, nums, sets = whole.slice(at, 1000), [], []
                for num, key, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if num not in done and xxhash.xxh3_128_digest(own := shingles(t, hashes).tobytes()) == key:
                        nums.append(num)
                        sets.append(own)
                        done.add(num)
                yield pa.RecordBatch.from_arrays([pa.array(nums, pa.int64()), pa.array(sets, pa.binary())], ["num", "set"])

    return docs.join(wanted.hint("shuffle_hash"), "doc_id").select("num", "set_hash", "text").mapInArrow(run, "num long, set binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough: 100 * intersection >= PERCENT * union."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, keep = whole.slice(at, 256), []
                for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                    if close(x.as_py(), y.as_py()):
                        keep.append(i)
                keep = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return shared.written(both.mapInArrow(compare, "a long, b long"), "links")


def crossed(rows: DataFrame, best: bool) -> DataFrame:
    """Surviving pairs (a, b) of different components of a chunk of a bucket and what it meets: of each member outside of
    the main component the likeliest one, or all, each in the first band that the pair shares.

    rows: bucket, chunk, with_ (what the chunk meets), streamed, main, self (the chunk meets itself), num, component,
    signature, place, set (of large buckets, whose pairs are verified here until their components meet; else null), in order
    of bucket, chunk, with_, streamed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, parent = None, None, {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        def meets(comp: int, mine: bytes, comps: np.ndarray, sets: np.ndarray) -> list[int]:
            """Places whose sets are close to mine, one for each component that is not yet joined to mine."""
            out = []
            for k, (c, theirs) in enumerate(zip(comps.tolist(), sets, strict=True)):
                if root(c) != root(comp) and close(mine, theirs):
                    parent[root(c)] = root(comp)
                    out.append(k)
            return out

        def pairs(left: tuple, right: tuple, place: int, ordered: bool = False) -> pa.RecordBatch | None:
            out = []
            for i, comp, sig, own_set in zip(*left, strict=True):
                able = right[1] != comp
                if ordered and not best:
                    able &= right[0] > i
                at = np.flatnonzero(able)
                if len(at):
                    at = at[likely(np.broadcast_to(sig, (len(at), HASHES)), right[2][at])]
                if len(at) and best:
                    at = at[[int((right[2][at] == sig).sum(axis=1).argmax())]]
                elif len(at):
                    shared_bands = (right[2][at] == sig).reshape(-1, BANDS, ROWS).all(axis=2)
                    at = at[shared_bands.argmax(axis=1) == place]
                    if own_set is not None:
                        at = at[meets(int(comp), own_set, right[1][at], right[3][at])]
                out += [(min(i, j), max(i, j)) for j in right[0][at]]
            return pa.RecordBatch.from_arrays([pa.array([int(x) for x, _ in out], pa.int64()), pa.array([int(y) for _, y in out], pa.int64())], ["a", "b"]) if out else None

        for whole in batches:
            bucket, chunk, with_, streamed, main, itself, num, comp, sig, places, sets = (whole.column(i) for i in range(11))
            keys = np.stack([*(x.to_numpy() for x in (bucket, chunk, with_)), streamed.to_numpy(zero_copy_only=False).astype(np.int64)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), whole.num_rows]
            ids, comps = num.to_numpy(), comp.to_numpy()
            sigs, bytes_of = np.frombuffer(b"".join(sig.to_pylist()), np.uint32).reshape(-1, HASHES), np.array([*sets.to_pylist(), None], object)[:-1]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                now, here, place, found = tuple(keys[x, :3]), (ids[x:y], comps[x:y], sigs[x:y], bytes_of[x:y]), int(places[x].as_py()), []
                if now != key:
                    key, held = now, None
                    parent.clear()
                if not keys[x, 3]:
                    if itself[x].as_py():
                        found.append(pairs(here, here, place, True))
                        if held is not None:  # the chunk came in several batches
                            found.append(pairs(here, held, place))
                    held = here if held is None else tuple(np.concatenate(z) for z in zip(held, here, strict=True))
                elif held is not None:
                    found.append(pairs(held, here, place))
                    if best and not main[x].as_py():
                        found.append(pairs(here, held, place))
                yield from (f for f in found if f is not None)

    return rows.mapInArrow(run, "a long, b long")


def open_buckets(members: DataFrame, found: DataFrame, reps: DataFrame, sets: DataFrame | None, part_size: int) -> DataFrame:
    """Rows for crossed(): the members of buckets that hold several components, with the sets of large ones if given."""
    placed = members.join(found, members["num"] == found["node"], "left").select("bucket", "place", "n", "first", "num", F.coalesce("component", "num").alias("component"))
    placed = shared.written(placed, "placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.when(F.col("num") == F.col("first"), F.col("component"))).alias("main_component")).filter("low < high")
    open_ = placed.join(mixed.select("bucket", "main_component"), "bucket").withColumn("main", F.col("component") == F.col("main_component"))
    others = open_.filter("not main").groupBy("bucket").agg(F.count("*").alias("others"))
    open_ = open_.join(others, "bucket")
    cut = lambda n: F.ceil(n / part_size).cast("int")
    open_ = open_.withColumns({"chunks": cut(F.col("others")), "parts": cut(F.col("n") - F.col("others"))})
    open_ = open_.withColumn("own", F.pmod(F.xxhash64("num"), F.when(F.col("main"), F.col("parts")).otherwise(F.col("chunks"))).cast("int"))
    to = lambda chunk, with_, streamed: F.struct(chunk.alias("chunk"), with_.alias("with_"), F.lit(streamed).alias("streamed"))
    # a chunk meets all parts, itself, and the chunks before it, which stream by
    every = lambda last, f: F.transform(F.sequence(F.lit(0), last), f)
    holds = every(F.col("parts") + F.col("own"), lambda r: to(F.col("own"), r, False))
    later = F.filter(every(F.col("chunks") - 1, lambda k: to(k, F.col("parts") + F.col("own"), True)), lambda x: x["chunk"] > F.col("own"))
    streams = every(F.col("chunks") - 1, lambda k: to(k, F.col("own"), True))
    dealt = open_.withColumn("task", F.explode(F.when(F.col("main"), streams).otherwise(F.concat(holds, later))))
    dealt = dealt.select("bucket", "task.*", "main", "num", "component", "place", "n", (F.col("task.with_") == F.col("parts") + F.col("task.chunk")).alias("self"))
    rows = dealt.join(reps, "num")
    if sets is None:
        rows = rows.withColumn("set", F.lit(None).cast("binary"))
    else:
        few = rows.filter(F.col("n") <= LARGE).withColumn("set", F.lit(None).cast("binary"))
        rows = few.unionByName(rows.filter(F.col("n") > LARGE).join(sets, "num"))
    rows = rows.select("bucket", "chunk", "with_", "streamed", "main", "self", "num", "component", "signature", "place", "set")
    return rows.repartition("bucket", "chunk", "with_").sortWithinPartitions("bucket", "chunk", "with_", "streamed")


def linked(docs: DataFrame, text: str = "text", part_size: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    cut = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("binary").alias("text"))
    signed_docs = shared.written(signed(cut), "signatures")
    whole = signed_docs.filter(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
    classes = whole.groupBy("n_shingles", "set_hash").agg(F.min("doc_id").alias("class_id"), F.min("signature").alias("signature"))
    classes = shared.written(classes.withColumn("num", F.monotonically_increasing_id()), "classes")
    reps = classes.select("num", "signature")

    # bands: the same 4 minima in the same place; the place is part of the key
    keys = F.array(*[F.xxhash64(F.lit(i), F.expr(f"substring(signature, {i * ROWS * 4 + 1}, {ROWS * 4})")) for i in range(BANDS)])
    bands = reps.select("num", F.posexplode(keys).alias("place", "bucket"))
    buckets = bands.groupBy("bucket").agg(F.min("num").alias("first"), F.count("*").alias("n")).filter("n > 1")
    members = shared.written(bands.join(buckets, "bucket"), "members")
    wanted = classes.join(members.select("num").distinct(), "num", "left_semi").select("num", F.col("class_id").alias("doc_id"), "set_hash")
    sets = shared.written(shingle_sets(cut, wanted), "sets")

    # classes that share a doc_id are linked
    several = whole.withColumn("h", F.xxhash64("set_hash")).groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low < high").select("doc_id")
    nodes = whole.join(several, "doc_id").select("doc_id", "n_shingles", "set_hash").distinct().join(classes.select("n_shingles", "set_hash", "num"), ["n_shingles", "set_hash"]).select("doc_id", "num")
    given = shared.written(nodes.join(nodes.groupBy("doc_id").agg(F.min("num").alias("a")), "doc_id").select("a", F.col("num").alias("b")).filter("a <> b"), "links")

    pairs = members.groupBy("num").agg(F.min("first").alias("first")).filter("num <> first").select(F.col("first").alias("a"), F.col("num").alias("b"))
    links = given.unionByName(verified(survivors(pairs, reps), sets))
    for best in (True, False):
        more = crossed(open_buckets(members, components(links), reps, None if best else sets, part_size), best).distinct()
        links = links.unionByName(verified(shared.written(more, "survivors"), sets))
    found = components(links)

    numbered = classes.join(found, classes["num"] == found["node"], "left").select("n_shingles", "set_hash", "class_id", F.coalesce("component", "num").alias("component"))
    least = numbered.groupBy("component").agg(F.min("class_id").alias("component_id"))
    by_class = numbered.join(least, "component").select("n_shingles", "set_hash", "component_id")
    full = signed_docs.filter("n_shingles > 0").join(by_class, ["n_shingles", "set_hash"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    # a row without shingles follows the rows that have its doc_id and some
    bare = signed_docs.filter("n_shingles = 0").select("doc_id", "n_shingles")
    ids = bare.select(F.col("doc_id").alias("bare_id")).distinct()
    follow = whole.join(ids, F.col("doc_id") == F.col("bare_id")).join(by_class, ["n_shingles", "set_hash"]).groupBy("bare_id").agg(F.min("component_id").alias("followed"))
    bare = bare.join(follow, F.col("doc_id") == F.col("bare_id"), "left").select("doc_id", "n_shingles", F.coalesce("followed", "doc_id").alias("component_id"))
    out = full.unionByName(bare)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(shared.table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS shingle FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared.n >= 75 * (p.n + q.n - shared.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.other = edges.a)
SELECT reach.doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, min(other) AS component_id, reach.doc_id = min(other) AS kept
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY reach.doc_id
"""
