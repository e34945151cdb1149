"""Decoded logs and finished tables as DataFrames."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_messages(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """All decoded messages below a folder partitioned by ``message``; a filter on it prunes folders."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(root)


def message_table(messages: DataFrame, name: str) -> DataFrame:
    return messages.where(F.col("message") == name).drop("message")


def read_text_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A delimited table with every column as text, so that bad cells can be reported instead of lost."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A sidecar that may be missing; an absent one is an empty table."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


MANIFEST = T.StructType([
    T.StructField("log_id", T.StringType()),
    T.StructField("raw_sha256", T.StringType()),
    T.StructField("coordinate_frame", T.StringType()),
    T.StructField("valid_counts", T.MapType(T.StringType(), T.LongType())),
    T.StructField("file_hashes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("flight_segments", T.ArrayType(T.StructType([
        T.StructField("flight_id", T.LongType()),
        T.StructField("arm_time_s", T.DoubleType()),
        T.StructField("end_time_s", T.DoubleType()),
    ]))),
])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifests of many logs, one JSON document per file."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def manifest_segments(manifest: DataFrame) -> DataFrame:
    to_us = lambda c: F.rint(F.col(c) * 1e6).cast("bigint")
    rows = manifest.select("log_id", F.explode("flight_segments").alias("_s"))
    return rows.select("log_id", "_s.flight_id", to_us("_s.arm_time_s").alias("start_us"), to_us("_s.end_time_s").alias("end_us"))


def manifest_digests(manifest: DataFrame) -> DataFrame:
    return manifest.select("log_id", F.explode("file_hashes").alias("name", "digest"))


def manifest_valid_counts(manifest: DataFrame) -> DataFrame:
    return manifest.select("log_id", *[F.col("valid_counts")[f"d{a}"].alias(f"valid_d{a}") for a in "xyz"])
