"""Rows identified by (doc_id, hash of the text), and spans of tokens joined to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import text_or_empty

NO_ID = -(1 << 63)  # stands for a null doc_id in keys
SPANS = "array<struct<first:bigint,end:bigint>>"


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))


def keyed(docs: DataFrame) -> DataFrame:
    """(key, text_hash, text): equal rows share a key, as they share every result."""
    return docs.select(doc_key().alias("key"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))


def gather(spans: DataFrame) -> DataFrame:
    """Spans (key, text_hash, first, end) of each text as one array; a text's spans are bounded by its length."""
    return spans.groupBy("key", "text_hash").agg(F.collect_list(F.struct("first", "end")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """All columns of docs in a struct ``row``, the text, and the spans found in it."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_key().alias("key"),
                       F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))
    return rows.join(spans, ["key", "text_hash"], "left").select(
        "row", "text", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")
    )
