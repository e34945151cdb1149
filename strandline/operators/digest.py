"""Digests and counts that let a later job prove it reads what an earlier one wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.numeric import count_true


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file below a path, one task per group of files. Spark reads a file as one value, so
    this is for sidecars and reports; tables are covered by ``table_digest``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("digest"), "length")


def content_digest(df: DataFrame, keys, content: str) -> DataFrame:
    return df.select(*keys, F.sha2(F.encode(content, "UTF-8"), 256).alias("digest"), F.octet_length(content).cast("bigint").alias("length"))


def table_digest(df: DataFrame, keys=()) -> DataFrame:
    """Row count and a sum of row hashes: the same whatever the order or the number of files.

    A row is hashed as the text of its columns in the order of their names; each is marked as present or missing, so a value
    that moves to another column shows. Any system that writes these texts alike can check the digest.
    """
    columns = sorted(c for c in df.columns if c not in keys)
    text = F.concat_ws("\u001f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns], F.lit(""))
    row = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    # A column of its own: inside the sum the whole text would be made anew for every place that names it.
    rows = df.select(*keys, row.alias("_row"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("_row").cast("string").alias("digest"))


def reconcile_digests(expected: DataFrame, actual: DataFrame, keys=("log_id",)) -> DataFrame:
    """Expected artifacts that are missing or differ."""
    other = actual.select(*keys, "name", F.col("digest").alias("_actual"))
    bad = expected.join(other, [*keys, "name"], "left").where(
        F.col("_actual").isNull() | (F.col("_actual") != F.col("digest"))
    )
    return bad.select(*keys, F.lit("artifact_digest").alias("rule"), F.col("name").alias("scope"),
                      F.lit(1).cast("bigint").alias("n_bad"), F.col("_actual").alias("example"))


def manifest_counts(df: DataFrame, axes=("x", "y", "z"), keys=("log_id",)) -> DataFrame:
    """Rows, valid and eligible rows per axis, and number of flights."""
    valid = [count_true(F.col(f"valid_d{a}")).alias(f"valid_d{a}") for a in axes]
    fit = [count_true(F.col(f"eligible_d{a}")).alias(f"eligible_d{a}") for a in axes if f"eligible_d{a}" in df.columns]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), *valid, *fit, F.count_distinct("flight_id").alias("n_flights")
    )


def reconcile_counts(recorded: DataFrame, actual: DataFrame, columns, keys=("log_id",)) -> DataFrame:
    """Recorded counts that differ from the recomputed ones."""
    now = actual.select(*keys, *[F.col(c).alias(f"_now_{c}") for c in columns])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("scope"), F.col(c).cast("bigint").alias("was"), F.col(f"_now_{c}").cast("bigint").alias("now"))
        for c in columns
    ])).alias("_p")
    rows = recorded.join(now, list(keys), "left").select(*keys, pairs)
    bad = rows.where(F.col("_p.was").isNotNull() & ~F.col("_p.was").eqNullSafe(F.col("_p.now")))
    return bad.select(*keys, F.lit("recorded_counts").alias("rule"), F.col("_p.scope").alias("scope"),
                      F.lit(1).cast("bigint").alias("n_bad"), F.col("_p.now").cast("string").alias("example"))
