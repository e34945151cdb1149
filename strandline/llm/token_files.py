"""Token-ID files: flat unsigned integers and 64-bit document offsets, memory-mapped on reading.

A shard is three files: ``.bin`` holds the ids of all its documents one after the other, ``.off`` the start of every
document and the end of the last one (unsigned 64-bit, counted in ids from the shard's start), ``.doc`` the document
numbers (signed 64-bit). Shards hold ascending ranges of doc_id; a shard's base is the prefix sum of the ids before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.shared import drafts, mounted, prepare, shared_folder, store, text_or_empty
from strandline.llm.tokens import DEFAULT_TOKENIZER, encoder

NO_ID = -(1 << 63)  # stands for a null doc_id in .doc files
MANIFEST = "shard int, path string, width int, n_docs bigint, n_tokens bigint"
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
_OUT = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])
READ_DOCS = 4096


def write_token_files(docs: DataFrame, folder: str, end_id: int = 1, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Encode every document's whole text and write the shards; returns the manifest, one row a shard.

    A null text is empty, so its document is the end id alone. Null doc_ids come first; repeated doc_ids are kept, each
    as a document of its own, in the order of their texts' hashes. Other columns are ignored. The folder must be mounted
    on driver and executors. A task that runs again writes the same files again. Ids leave for the files batch by batch, so a task
    holds one batch however large its shard is; a shard without documents has files but no row in the manifest.
    """
    prepare(docs.sparkSession)
    path = mounted(folder)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer), TaskContext.get()
        end = np.array([end_id], enc.dtype).tobytes()
        name, n_docs, n_tokens = f"{path}/shard-{task.partitionId():06d}", 0, 0
        with drafts([f"{name}.bin", f"{name}.off", f"{name}.doc"], task.taskAttemptId()) as (ids, offsets, keys):
            for batch in batches:
                starts = []
                for text in batch.column(1).to_pylist():
                    part = enc.encode(text).tobytes() + end
                    ids.write(part)
                    starts.append(n_tokens)
                    n_tokens += len(part) // enc.dtype.itemsize
                offsets.write(np.array(starts, "<u8").tobytes())
                keys.write(np.array([NO_ID if d is None else d for d in batch.column(0).to_pylist()], "<i8").tobytes())
                n_docs += batch.num_rows
            offsets.write(np.array([n_tokens], "<u8").tobytes())
        if n_docs:
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([task.partitionId()], pa.int32()), "path": [name],
                "width": pa.array([enc.dtype.itemsize], pa.int32()), "n_docs": [n_docs], "n_tokens": [n_tokens],
            })

    return store(rows.mapInArrow(write, MANIFEST), "token-manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """Each shard's base: the ids in all shards before it. One row a shard, so one window holds them."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the shards as (doc_id, start, n_tokens, ids_crc32), read from the memory-mapped files."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                ids = np.memmap(f"{shard['path']}.bin", f"<u{shard['width']}", "r")
                off = np.memmap(f"{shard['path']}.off", "<u8", "r")
                doc = np.memmap(f"{shard['path']}.doc", "<i8", "r")
                for first in range(0, shard["n_docs"], READ_DOCS):
                    cut = off[first:first + READ_DOCS + 1].astype(np.int64)
                    keys = np.array(doc[first:first + READ_DOCS])
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1], cut[1:])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys, mask=keys == NO_ID), pa.array(cut[:-1] + shard["base"]), pa.array(np.diff(cut)),
                        pa.array(crc, pa.int64()),
                    ], schema=_OUT)

    spark = manifest.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    return with_bases(manifest).repartition(tasks, "shard").mapInArrow(read, ROWS)


def token_id_files(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Write all documents to a new shared folder and read them back."""
    folder = shared_folder(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, tokenizer=tokenizer))
