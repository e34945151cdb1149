"""Releases: the tables of one job run, written aside and published together or not at all.

    root/runs/<run>/<table>/     parquet files of one run
    root/commits/<number>.json   one line: the run and its tables with rows and digest

A run is readable once its commit has its name. The commit is written under another name first and renamed, which every file
system Spark writes to does in one step for a file of a few hundred bytes; readers take the commit of the highest number, so they
see the tables of one run and never those of two. A job that fails leaves no commit, and what it had written is taken away again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.digest import table_digest

DIGESTS = "digests"  # the table of digests by log and table that every release has


def _files(spark: SparkSession, path: str):
    """Spark's own file system for a path, and the path as it wants it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


class Draft:
    """A run that is being written."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.run = spark, root.rstrip("/"), uuid.uuid4().hex
        self.tables: dict[str, DataFrame] = {}

    @property
    def path(self) -> str:
        return f"{self.root}/runs/{self.run}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Store a table of the run; what comes back reads the stored files, so later steps see what readers will see."""
        if name in self.tables:
            raise ValueError(f"{name} is already part of this run")
        df.write.parquet(f"{self.path}/{name}")
        self.tables[name] = self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")
        return self.tables[name]

    def publish(self) -> None:
        """Digests of all tables that have a log, then the commit."""
        named = {n: t for n, t in self.tables.items() if "log_id" in t.columns}
        self.write(DIGESTS, digests(named))
        totals = self.tables[DIGESTS].groupBy("name").agg(F.sum("n_rows").alias("n_rows"), F.sum(F.col("digest").cast("decimal(38,0)")).cast("string").alias("digest"))
        found = {r.name: {"rows": r.n_rows, "digest": r.digest} for r in totals.collect()}  # one row a table
        body = {"run": self.run, "tables": {name: found.get(name, {}) for name in self.tables}}
        number = max(commit_numbers(self.spark, self.root), default=-1) + 1
        files, draft = _files(self.spark, f"{self.root}/commits/.{self.run}.draft")
        _, final = _files(self.spark, f"{self.root}/commits/{number:012d}.json")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(body, sort_keys=True).encode()))
        out.close()
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise RuntimeError(f"another run was published as {number} in {self.root}")

    def discard(self) -> None:
        files, path = _files(self.spark, self.path)
        files.delete(path, True)


@contextmanager
def draft(spark: SparkSession, root: str) -> Iterator[Draft]:
    """A run that is published when the block ends and taken away when it fails."""
    run = Draft(spark, root)
    try:
        yield run
        run.publish()
    except BaseException:
        run.discard()
        raise


def digests(tables: dict[str, DataFrame]) -> DataFrame:
    """(log_id, name, n_rows, digest) of every log and table; columns of any type are read as their text."""
    return reduce(DataFrame.unionByName, [
        table_digest(t, ["log_id"]).select("log_id", F.lit(name).alias("name"), "n_rows", "digest") for name, t in sorted(tables.items())
    ])


def commit_numbers(spark: SparkSession, root: str) -> list[int]:
    files, path = _files(spark, f"{root.rstrip('/')}/commits")
    names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


@dataclass(frozen=True)
class Release:
    """A published run."""

    run: str
    number: int
    tables: dict[str, DataFrame]
    recorded: dict[str, dict]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"this release has no table {name}")
        return self.tables[name]

    def get(self, name: str) -> DataFrame | None:
        return self.tables.get(name)

    def actual_digests(self) -> DataFrame:
        """The digests of the tables as they are read now."""
        return digests({n: t for n, t in self.tables.items() if n != DIGESTS and "log_id" in t.columns})


def read_release(spark: SparkSession, root: str, number: int | None = None) -> Release:
    """The newest release below a folder, or that of a number. A folder without one is refused."""
    numbers = commit_numbers(spark, root)
    if number is None and not numbers or number is not None and number not in numbers:
        raise ValueError(f"nothing is published in {root}" if number is None else f"release {number} is not published in {root}")
    number = numbers[-1] if number is None else number
    root = root.rstrip("/")
    body = json.loads(spark.read.text(f"{root}/commits/{number:012d}.json").first().value)
    tables = {name: spark.read.parquet(f"{root}/runs/{body['run']}/{name}") for name in body["tables"]}
    return Release(body["run"], number, tables, body["tables"])
