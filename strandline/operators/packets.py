"""Byte coverage of a log, from the index of its decoded packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.ordered import Scan, rank_chunk


def packet_gaps(packets: DataFrame, index: str = "record_index") -> DataFrame:
    """Regions between packets that no packet accounts for. The first one is compared with offset 0."""
    rows = packets.withColumn("_end", F.col("offset") + F.col("length"))
    rows = Scan(rank_chunk(rows, index), ["log_id"], (index,)).previous("_before", "_end").run()
    last_end = F.coalesce("_before._end", F.lit(0))
    return rows.where(F.col("offset") > last_end).select(
        "log_id", last_end.alias("gap_offset"), (F.col("offset") - last_end).alias("byte_count")
    )


def coverage(packets: DataFrame, files: DataFrame, gaps: DataFrame) -> DataFrame:
    """Accounted, skipped and trailing bytes per log. ``files`` has log_id, file_bytes and, where the file ends
    in the header of a known packet, the length it announces (``tail_expected``)."""
    ends = packets.groupBy("log_id").agg(
        F.max(F.col("offset") + F.col("length")).alias("last_end"), F.count(F.lit(1)).alias("packets")
    )
    lost = gaps.groupBy("log_id").agg(F.count(F.lit(1)).alias("skipped_regions"), F.sum("byte_count").alias("skipped_bytes"))
    rows = files.join(ends, "log_id", "left").join(lost, "log_id", "left")
    rows = rows.fillna(0, ["last_end", "packets", "skipped_regions", "skipped_bytes"])
    trailing = F.greatest(F.lit(0), F.col("file_bytes") - F.col("last_end"))
    rows = rows.withColumn("trailing_bytes", trailing)
    cut = F.coalesce(F.col("trailing_bytes") < F.col("tail_expected"), F.lit(False)) & (F.col("trailing_bytes") >= 3)
    kind = F.when(F.col("trailing_bytes") == 0, F.lit(None).cast("string")).when(cut, F.lit("truncated_message")).otherwise(F.lit("unparsed_trailing_bytes"))
    return rows.select(
        "log_id", "packets", "file_bytes", "last_end", "skipped_regions", "skipped_bytes", "trailing_bytes",
        kind.alias("trailing_kind"), (F.col("last_end") + F.col("trailing_bytes")).alias("accounted_bytes"),
    )


def parser_status(covered: DataFrame) -> DataFrame:
    """A lone cut-off last packet is a warning; any other anomaly fails."""
    tail_only = (F.col("skipped_regions") == 0) & F.coalesce(F.col("trailing_kind") == "truncated_message", F.lit(False))
    clean = (F.col("skipped_regions") == 0) & (F.col("trailing_bytes") == 0)
    status = F.when(clean, F.lit("PASS")).when(tail_only, F.lit("PASS_WITH_WARNINGS")).otherwise(F.lit("FAIL"))
    anomalies = F.col("skipped_regions") + F.when(F.col("trailing_bytes") > 0, 1).otherwise(0)
    return covered.withColumn("anomalies", anomalies).withColumn("status", status)
