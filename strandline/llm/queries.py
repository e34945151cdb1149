"""Registered queries of the subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import (
    decontaminate, doubling, forest, hyperplanes, licenses, packing, rotations, suffixes, token_files, toxicity, transducers, warc,
    whitening,
)
from strandline.llm.shared import table


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, folder, "pages"))


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return doubling.substring_digests(table(spark, folder, "documents"))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.suffix_digests(table(spark, folder, "documents"))


def op5_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return rotations.near_vectors(table(spark, folder, "embeddings"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_id_files(table(spark, folder, "documents"))


def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return forest.jaccard_join(table(spark, folder, "documents")).drop("text_hash")


def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return transducers.count_tokens(table(spark, folder, "documents"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh row's label is shifted first, so that labels disagree with the vectors' neighbourhoods."""
    shifted = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hyperplanes.hard_negatives(table(spark, folder, "embeddings").withColumn("label", shifted))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_warc, op3_substring_dedup, op4_suffix_dedup, op5_near_vectors, op6_packing, op7_token_files,
    op8_licenses, op9_decontaminate, op10_jaccard_join, op11_token_counts,
    op12_whitening, op13_hard_negatives,
)}
