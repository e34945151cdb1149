"""Steps that several operators of this subpackage share: tables, stored intermediates, mounted folders, words."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from pathlib import Path
from typing import BinaryIO
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import ensure_checkpoint_dir

BATCH_ROWS = 512
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library; others have none
ROOT = str(Path(__file__).resolve().parents[2])

# Every byte that is no part of a word [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z is lower-cased.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, as texts may be long; shuffle files go when their query has ended.

    Python workers on the driver's machine find this package where the driver found it; a cluster is given it by --py-files.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    if spark.sparkContext.master.startswith("local"):
        paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
        if ROOT not in paths:
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one written result below the cluster's shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table that later steps read several times; it outlives lost executors and cuts the lineage.

    Its size is then known to the planner, which broadcasts it only where it is small.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mounted(uri: str) -> str:
    """The path of a folder that driver and executors mount alike; other stores cannot be memory-mapped."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"a mounted folder is needed, not {uri}")
    return parts.path


def write_whole(path: str, parts: list[bytes], attempt: int) -> None:
    """Write one file so that readers see either all of it or nothing, however often a task is tried."""
    draft = f"{path}.{attempt}.{uuid.uuid4().hex}.draft"
    with open(draft, "wb") as out:
        for part in parts:
            out.write(part)
    os.replace(draft, path)


@contextmanager
def drafts(paths: list[str], attempt: int) -> Iterator[list[BinaryIO]]:
    """Files written piece by piece that take their names only when all are whole, however often a task is tried."""
    os.makedirs(os.path.dirname(paths[0]), exist_ok=True)
    names = [f"{path}.{attempt}.{uuid.uuid4().hex}.draft" for path in paths]
    with ExitStack() as stack:
        yield [stack.enter_context(open(name, "wb")) for name in names]
    for name, path in zip(names, paths):
        os.replace(name, path)


def give_back() -> None:
    """Return to the system what the allocators hold free: a worker process lives on beside the executor for other stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def folded_words(text: str) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
