"""Mixing sources to target weights by entropy balancing, in DataFrame expressions only.

Of all rates that give a source its target of words and lie between 0 and `most` copies, those nearest to one copy each
in relative entropy are min(most, exp(tilt * size)): one tilt for each source, where the dual's gradient vanishes. Newton
steps find it, kept inside a bracket; each is one aggregation by source over a table of (source, size, count) with partial
sums, joined with the small table of tilts, so no task holds a source's documents. Rates become copies on the same table:
running sums in order of size are rounded, and documents of fitting sizes then close what is left of the gap. Within one
size and source, documents are ranked by a hash in two levels, so a hot size is split as well.

Defined results: a null text or one without words has size 0 and is taken 0 times; a null source is a source of its own,
last in order; repeated rows count and are taken as rows of their own; ties in rank go by the hash, then arbitrarily
among identical rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

WEIGHTS = (3, 1, 2)


def ordered_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sources with `weight`: the weights repeat over the sources by code point, null last. One row per source; the rank
    comes from ranges, so that no task holds all sources."""
    spread = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    spread = shared.written(spread, "sources")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    bases = spread.groupBy("_part").count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    rank = spread.withColumn("_local", local).join(bases, "_part")
    place = ((F.col("_base") + F.col("_local") - 1) % len(weights) + 1).cast("int")
    return rank.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place)).drop("_part", "_base", "_local")


def with_targets(sources: DataFrame, total_factor: float, most: float) -> DataFrame:
    """sources (source, total, weight) with `target`: shares of total_factor times all words by weight, none above `most`
    times its source's words; excess is shared again by weight until none is above."""
    level, capped = 0.0, -1.0
    row = sources.agg(F.sum("total"), F.sum("weight")).first()
    goal, room, weight = (row[0] or 0) * total_factor, (row[0] or 0) * total_factor, row[1] or 1.0
    while weight > 0:  # each turn caps more sources, or ends
        level = room / weight
        over = F.col("total") * most < F.lit(level) * F.col("weight")
        held, rest = sources.agg(F.sum(F.when(over, F.col("total") * most)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if (held or 0.0) == capped:
            break
        capped = held or 0.0
        room, weight = goal - capped, rest or 0.0
    return sources.withColumn("target", F.least(F.col("total") * float(most), F.lit(level) * F.col("weight")))


def tilts(sizes: DataFrame, sources: DataFrame, most: float, precision: float = 1e-7) -> DataFrame:
    """source with `tilt` (null: every document `most` times) and mean size `scale`, from written tables sizes (source,
    size, n) and sources (source, total, target). Steps are taken on the logarithm of the words, within a bracket whose
    ends are null while open. Turns go on until every source's words are within `precision`, or its bracket has closed to
    neighbouring numbers; each turn's table replaces the one before."""
    spark = sizes.sparkSession
    scale = sizes.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("scale"))
    state = sources.join(scale, sources["source"].eqNullSafe(scale["source"])).drop(scale["source"])
    full = F.col("target") >= F.col("total") * (most - 1e-9)
    end = F.lit(None).cast("double")
    state = state.select("source", "target", "scale", full.alias("full"), F.lit(0.0).alias("tilt"), end.alias("low"), end.alias("high"))
    state, path = shared.written_at(state, "tilts")
    while True:
        each = sizes.join(state, sizes["source"].eqNullSafe(state["source"])).drop(state["source"]).filter(~F.col("full"))
        x = F.col("size") / F.col("scale")
        rate = F.exp(F.least(F.col("tilt") * x, F.lit(50.0)))
        words = F.col("n") * F.col("size")
        sums = each.groupBy("source").agg(F.sum(words * F.least(rate, F.lit(float(most)))).alias("f"), F.sum(F.when(rate < most, words * rate * x).otherwise(0.0)).alias("g"))
        joined = state.join(sums, state["source"].eqNullSafe(sums["source"]), "left").drop(sums["source"])
        gap = F.log(F.greatest(F.col("f"), F.lit(1e-300)) / F.col("target"))
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - gap * F.col("f") / F.when(F.col("g") > 0, F.col("g"))
        # outside the bracket: doubled away from 0 while an end is open, else halved
        half = (F.col("low_") + F.col("high_")) / 2
        middle = F.when(F.col("low_").isNull(), F.least(F.col("tilt") * 2, F.lit(-1.0))).when(F.col("high_").isNull(), F.greatest(F.col("tilt") * 2, F.lit(1.0))).otherwise(half)
        moved = joined.withColumns({"gap": gap, "step": step, "low_": low, "high_": high})
        # a step beyond an open end reaches no farther than the doubled one
        reach = (F.abs("step") <= F.greatest(F.lit(1.0), F.abs(F.col("tilt")) * 2)) | (F.col("low_").isNotNull() & F.col("high_").isNotNull())
        inside = (F.col("step") > F.coalesce("low_", F.lit(float("-inf")))) & (F.col("step") < F.coalesce("high_", F.lit(float("inf")))) & reach
        closed = F.coalesce((half <= F.col("low_")) | (half >= F.col("high_")), F.lit(False))
        done = F.col("full") | F.col("f").isNull() | (F.abs("gap") < precision) | closed
        moved = moved.withColumn("next", F.when(done, F.col("tilt")).when(inside, F.col("step")).otherwise(middle))
        after, there = shared.written_at(moved.select("source", "target", "scale", "full", F.col("next").alias("tilt"), F.col("low_").alias("low"), F.col("high_").alias("high"), F.coalesce(done, F.lit(False)).alias("done")), "tilts")
        shared.remove(spark, path)
        state, path = after, there
        if state.filter(~F.col("done")).isEmpty():
            break
    return state.select("source", F.when(~F.col("full"), F.col("tilt")).alias("tilt"), "scale")


def copies_by_size(sizes: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """sizes with `copies`: how many copies of its n documents the mix takes in all; written.

    Expected copies are summed in order of falling size and rounded, so the words are off by half the largest size at most;
    mends then add or remove copies of the largest size that fits what is left of the gap, until none fits in any source.
    Each mend uses up a size or leaves a gap below it, so they end. A source's row count here is that of its distinct
    sizes, which the longest document bounds.
    """
    spark = sizes.sparkSession
    w = Window.partitionBy("source")
    down = w.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    rate = F.when(F.col("tilt").isNull(), F.lit(float(most))).otherwise(F.least(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(50.0))), F.lit(float(most))))
    some = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumn("_e", F.col("n") * rate)
    some = some.withColumn("_s", F.sum("_e").over(down))
    some = some.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("n") * most, F.round(F.col("_s")).cast("long") - F.round(F.col("_s") - F.col("_e")).cast("long"))))
    some, path = shared.written_at(some.select("source", "size", "n", "target", "total", F.col("copies").cast("long").alias("copies")), "copies")
    while True:
        gapped = some.withColumn("_gap", F.col("target") - F.sum(F.col("copies") * F.col("size")).over(w))
        room = F.when(F.col("_gap") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
        fits = (room > 0) & (F.col("size") > 0) & (F.col("size") <= F.abs("_gap"))
        picked = gapped.withColumn("_pick", F.max(F.when(fits, F.col("size"))).over(w))
        change = F.least(room, F.floor(F.abs("_gap") / F.col("size"))) * F.signum("_gap").cast("long")
        after = picked.withColumn("copies", F.when(F.col("size") == F.col("_pick"), F.col("copies") + change).otherwise(F.col("copies")).cast("long"))
        after, there = shared.written_at(after.select(*some.columns, F.col("_pick").isNotNull().alias("_mended")), "copies")
        shared.remove(spark, path)
        some, path = after.drop("_mended"), there
        if after.filter("_mended").isEmpty():
            break
    # one copy more or less of the smallest size that is above the gap, but brings the words nearer
    some = some.withColumn("_gap", F.col("target") - F.sum(F.col("copies") * F.col("size")).over(w))
    room = F.when(F.col("_gap") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
    some = some.withColumn("_pick", F.min(F.when((room > 0) & (F.col("size") >= F.abs("_gap")) & (F.col("size") < 2 * F.abs("_gap")), F.col("size"))).over(w))
    some = some.withColumn("copies", F.when(F.col("size") == F.col("_pick"), F.col("copies") + F.signum("_gap").cast("long")).otherwise(F.col("copies")))
    return shared.written(some.select("source", "size", "n", "target", "total", F.col("copies").cast("long").alias("copies")), "copies")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(shared.WORD)), F.lit(0)).cast("long")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", total_factor: float = 1.5, most: int = 2, weights: tuple[float, ...] = WEIGHTS, ranked_together: int = 50_000) -> DataFrame:
    """doc key, source, size, source_size, target and `copies` (0 to most) of each document. Documents of one source and
    size are ranked in hashed parts of about `ranked_together` rows; those without words take no part in the ranks."""
    each = shared.written(docs.select(F.col(key), F.col("source"), word_count(F.col(text)).alias("size")), "word-counts")
    sizes = shared.written(each.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    sources = ordered_weights(sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("total")), weights)
    sources = shared.written(with_targets(shared.written(sources, "weights"), total_factor, most).drop("weight"), "targets")
    found = tilts(sizes.filter("size > 0"), sources, float(most))
    found = found.join(sources, found["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    plan = copies_by_size(sizes.filter("size > 0"), found, most)

    # ranks in two levels: within hashed parts of each source and size, as many as its rows need, and of the parts before
    plan = plan.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "n", "copies", F.ceil(F.col("n") / ranked_together).alias("_parts"))
    parts = each.filter("size > 0").join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))).drop("_source", "_size")
    parts = parts.withColumn("_hash", F.xxhash64(F.col(key).cast("string"))).withColumn("_part", F.pmod("_hash", "_parts"))
    counted = parts.filter("_parts > 1").groupBy("source", "size", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # names of its own for the other side: both come from one table, so their columns could not be told apart
    counted = counted.select(F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("_part").alias("_of"), "_base")
    ranked = parts.withColumn("_row", F.row_number().over(Window.partitionBy("source", "size", "_part").orderBy("_hash")))
    out = ranked.join(counted, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("_part") == F.col("_of")), "left")
    rank = F.coalesce("_base", F.lit(0)) + F.col("_row") - 1
    # copies // n for all, one more for the first copies % n
    taken = F.floor(F.col("copies") / F.col("n")) + (rank < F.col("copies") % F.col("n")).cast("long")
    out = out.select(key, "source", "size", taken.cast("long").alias("copies"))
    out = out.unionByName(each.filter("size = 0").withColumn("copies", F.lit(0).cast("long")))
    return out.join(sources, out["source"].eqNullSafe(sources["source"])).drop(sources["source"]).select(key, "source", "size", F.col("total").cast("long").alias("source_size"), "target", "copies")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(shared.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
