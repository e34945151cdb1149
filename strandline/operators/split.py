"""Chronological train/test splits without leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.ordered import WHOLE_CELLS, Chunks, Scan
from strandline.operators.profile import attach


def candidates(df: DataFrame, flags=("valid_dx", "valid_dy", "valid_dz")) -> DataFrame:
    """Rows with any valid axis."""
    keep = F.lit(False)
    for flag in flags:
        keep = keep | F.coalesce(F.col(flag), F.lit(False))
    return df.where(keep)


def split_times(df: DataFrame, fraction: float, chunks: Chunks = WHOLE_CELLS, time: str = "time_us") -> DataFrame:
    """First test time per log: the distinct time at place int(n * fraction) of n."""
    times = df.where(F.col(time).isNotNull()).groupBy("log_id", F.col(time).alias("time_us")).agg(F.lit(1).alias("_one"))
    ranked = Scan(chunks.add(times), ["log_id"], ("time_us",)).total("place", F.col("_one")).run()
    totals = times.groupBy("log_id").agg(F.floor(F.count(F.lit(1)) * F.lit(float(fraction))).alias("_k"))
    return ranked.join(totals, "log_id").where("place = _k + 1").select("log_id", F.col("time_us").alias("test_from_us"))


def split_chronological(df: DataFrame, fraction: float = 0.7, chunks: Chunks = WHOLE_CELLS, time: str = "time_us") -> DataFrame:
    """Rows before the first test time train, the others test; rows of one time are never divided."""
    joined = attach(df, split_times(df, fraction, chunks, time), ["log_id"])
    return joined.withColumn(
        "split", F.when(F.col(time) < F.col("test_from_us"), F.lit("train")).otherwise(F.lit("test"))
    ).drop("test_from_us")


def holdout_problems(df: DataFrame, flight, time: str = "time_us") -> DataFrame:
    """Logs for which the held-out flight is absent, alone, or not after all training rows."""
    held = F.col("flight_id") == F.lit(flight)
    sums = df.groupBy("log_id").agg(
        F.bool_or(held).alias("present"), F.bool_or(~held).alias("others"),
        F.max(F.when(~held, F.col(time))).alias("last_train"), F.min(F.when(held, F.col(time))).alias("first_test"),
    )
    late = F.coalesce(F.col("last_train") >= F.col("first_test"), F.lit(False))
    reason = (
        F.when(~F.col("present"), F.lit("holdout flight absent"))
        .when(~F.col("others"), F.lit("no other flight"))
        .when(late, F.lit("training rows not before the holdout flight"))
    )
    return sums.withColumn("reason", reason).where("reason is not null").select("log_id", "reason")


def split_holdout(df: DataFrame, flight) -> DataFrame:
    return df.withColumn("split", F.when(F.col("flight_id") == F.lit(flight), F.lit("test")).otherwise(F.lit("train")))


def select_flights(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted (log_id, flight_id) pairs."""
    return df.join(wanted.select("log_id", "flight_id").distinct(), ["log_id", "flight_id"], "left_semi")


def absent_flights(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted flights that do not exist."""
    return wanted.select("log_id", "flight_id").distinct().join(segments, ["log_id", "flight_id"], "left_anti")
