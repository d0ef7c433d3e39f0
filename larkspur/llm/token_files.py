"""Token-ID output: flat files of unsigned integers with 64-bit document offsets, written and read in document order.

A folder holds, for each shard of the documents in ascending doc_id order: NAME.bin, the ids of all its documents, as
unsigned 16-bit integers if the vocabulary allows it, else 32-bit, little-endian; NAME.off, n+1 64-bit offsets in ids
within the shard; NAME.doc, n 64-bit doc_ids, 0 for a null one; NAME.nul, n bytes, 1 where the doc_id is null. manifest.json lists the shards in order, each with the number of documents
and ids in all shards before it, which are prefix sums of what the writing tasks report. A shard's name has a part of its
own for each attempt, and only names that successful attempts report are listed, so a lost executor leaves no harm.

Defined results: a null text is empty and has only the end id; documents with equal ids stand in order of a hash of their
texts, null first; a null doc_id comes first and is kept; a text of any length is one document; rows that share a doc_id may stand in several
shards, in order; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

MB_OF_IDS = 8


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1))


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, text: str = "text") -> list[dict]:
    """Writes the documents' ids, each document followed by end_id, to a folder that all executors share; the manifest."""
    from .encoder import encoder

    width = "<u2" if max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    system, path = opened(folder)
    system.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encode, last = TaskContext.get().partitionId(), encoder(tokenizer).encode, array("I", [end_id]).tobytes()
        name, places, ids, nulls = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}", array("q", [0]), array("q"), bytearray()
        store, out = None, None
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    store, where = opened(folder)
                    out = store.open_output_stream(f"{where}/{name}.bin")
                data = np.frombuffer(encode(content or "") + last, "<u4")
                out.write(data.astype(width).tobytes())
                places.append(places[-1] + len(data))
                ids.append(doc or 0)
                nulls.append(doc is None)
        if out is not None:
            out.close()
            for ending, values in (("off", places), ("doc", ids)):
                with store.open_output_stream(f"{where}/{name}.{ending}") as f:
                    f.write(np.asarray(values, "<i8").tobytes())
            with store.open_output_stream(f"{where}/{name}.nul") as f:
                f.write(bytes(nulls))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "name": [name], "docs": pa.array([len(ids)], pa.int64()), "ids": pa.array([places[-1]], pa.int64())})

    # ranges are sampled in the driver, so the texts themselves stay out of the key
    place = F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text))).alias("place")
    ordered = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"), place).repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place", "text").drop("place")
    shards, n_docs, n_ids = [], 0, 0
    for row in sorted(ordered.mapInArrow(write, "shard long, name string, docs long, ids long").collect()):
        shards.append({"name": row["name"], "docs": row["docs"], "ids": row["ids"], "docs_before": n_docs, "ids_before": n_ids})
        n_docs, n_ids = n_docs + row["docs"], n_ids + row["ids"]
    with system.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps({"width": width, "docs": n_docs, "ids": n_ids, "shards": shards}).encode())
    return shards


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit) of every document."""
    system, path = opened(folder)
    with system.open_input_stream(f"{path}/manifest.json") as f:
        manifest = json.loads(f.read())
    width = np.dtype(manifest["width"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = opened(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = lambda ending: np.frombuffer(store.open_input_file(f"{where}/{name}.{ending}").read(), "<i8")  # noqa: B023, E731
                places, docs = whole("off"), whole("doc")
                nulls = np.frombuffer(store.open_input_file(f"{where}/{name}.nul").read(), bool)
                local = isinstance(store, pafs.LocalFileSystem)
                data = np.memmap(f"{where}/{name}.bin", width, "r") if local else None
                flat = None if local else store.open_input_file(f"{where}/{name}.bin")
                first = 0
                while first < len(docs):  # as many documents as MB_OF_IDS hold, at least one
                    end = max(first + 1, int(np.searchsorted(places, places[first] + MB_OF_IDS * 250_000, "right")) - 1)
                    a, b = int(places[first]), int(places[end])
                    if local:
                        ids = data[a:b].astype("<u4")
                    else:
                        flat.seek(a * width.itemsize)
                        ids = np.frombuffer(flat.read((b - a) * width.itemsize), width).astype("<u4")
                    cuts = pa.array((places[first : end + 1] - a) * 4, pa.int64())
                    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - first, [None, cuts.buffers()[1], pa.py_buffer(ids.tobytes())]).cast(pa.binary())
                    keys = docs[first:end]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, mask=nulls[first:end]), pa.array(base + places[first:end]), pa.array(np.diff(places[first : end + 1])), column], ["doc_id", "start", "n_tokens", "ids"]
                    )
                    first = end

    rows = [(s["name"], s["ids_before"]) for s in manifest["shards"]]
    shards = spark.createDataFrame(rows, "name string, base long").repartition(max(1, len(rows)))
    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.fresh_path(spark, "tokens")
    write_tokens(shared.table(spark, sf_dir, "documents"), folder, "byte_bpe_50k.json", end_id=2)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
