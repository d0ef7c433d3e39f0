"""A corpus pipeline: language ID, near-dedup, secret removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows as Parquet to the shared
folder and reads them again for the next. All but the last return the columns of docs. Empty tables pass through every
stage; what null texts, very long ones, repeated rows and ties give is stated with each stage's operator and below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import langid, minhash, mixing, packing, secrets, shared

LEAST_SCORE = 0.5
ORACLE_SQL = None  # models, signatures and encoders are beyond SQL; a test holds run() against a brute-force pipeline


def named(name: str):
    return F.col(f"`{name}`")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose best language has a posterior below LEAST_SCORE. Where no language
    could be learned, every document with a letter stays."""
    shared.ship(spark)
    model = langid.fitted(docs)
    if not model.languages:
        return docs.filter(named("text").rlike(r"\p{L}"))
    pred, score = shared.unused(docs, "lang_pred"), shared.unused(docs, "lang_score")
    found = langid.identified(docs, model, pred=pred, score=score)
    return found.filter((named(pred) != "und") & (named(score) >= LEAST_SCORE)).select(*map(named, docs.columns))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group, one of rows that repeat doc_id and text; null doc_ids
    are in no group and stay."""
    shared.ship(spark)
    kept = minhash.linked(docs).filter("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(docs.filter("doc_id is null")).select(*map(named, docs.columns))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in a text by a mark; drops nothing."""
    weights = secrets.trained_weights(secrets.labelled_samples(docs))
    whole = docs.select(F.struct(*map(named, docs.columns)).alias("doc"), "text")
    found = secrets.secret_spans(whole, weights).withColumn("text", secrets.redacted(F.col("text"), F.col("spans")))
    return found.select(*[F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it, 0 to 2 times; null doc_ids and texts without words, which count
    for nothing in the mix, stay once. Rows that share a doc_id are taken equally often."""
    times = shared.unused(docs, "copies")
    mix = mixing.mixed(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))).alias(times))
    taken = docs.join(mix, "doc_id", "left").withColumn(times, F.coalesce(named(times), F.lit(1)).cast("int"))
    each = shared.unused(docs, "copy")
    return taken.filter(named(times) > 0).withColumn(each, F.explode(F.sequence(F.lit(1), named(times)))).select(*map(named, docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their ids (little-endian unsigned 32-bit)."""
    shared.ship(spark)
    return packing.packed(docs)


STAGES = [
    ("language_id", language_stage),
    ("minhash_dedup", dedup_stage),
    ("secret_scan", secrets_stage),
    ("source_mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
