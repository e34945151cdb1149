"""Benchmark decontamination by winnowing, in DataFrame functions only.

A fingerprint is the least hash of the k-grams in a sliding window of w of them, so two texts that share k + w - 1 words
share a fingerprint. Documents' and benchmark's fingerprints are joined; around each hit the sought windows are cut out of
the document and compared word by word with the benchmark's. Items shorter than a window are one window of their own length
with fingerprints of their own, so the guarantee holds for them as well.

Fingerprints are taken over wholly lower-cased words, which finds at least every match; the comparison itself lower-cases
A-Z only.

Arrays are unnested by explode_outer: for explode the optimizer infers a filter on the array's size, which it pushes into
the lambdas that made the array, so that each element makes the whole array again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import prepare, store, text_or_empty
from strandline.llm.spans import NO_ID, doc_key

WINDOW = 10
# Fixed value: what separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def _span(length: int) -> tuple[int, int]:
    """k and w of a window of so many words."""
    gram = (length + 1) // 2
    return gram, length - gram + 1


def _starts(size: Column, length: int) -> Column:
    """First places, from 0, of all runs of so many elements."""
    return F.when(size >= length, F.sequence(F.lit(0), size - length)).otherwise(F.array().cast("array<int>"))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _with_grams(rows: DataFrame, span: int) -> DataFrame:
    """The hash of every k-gram of column hashes, as column grams."""
    gram, _ = _span(span)
    return rows.withColumn("grams", F.transform(
        _starts(F.size("hashes"), gram),
        lambda i: F.xxhash64(F.lit(span), *[F.get(F.col("hashes"), i + j) for j in range(gram)]),
    ))


def _with_prints(rows: DataFrame, span: int) -> DataFrame:
    """The distinct fingerprints of all windows of column hashes, as column prints."""
    _, wide = _span(span)
    least = F.transform(_starts(F.size("grams"), wide), lambda i: F.array_min(F.array(
        *[F.get(F.col("grams"), i + j) for j in range(wide)]
    )))
    return _with_grams(rows, span).withColumn("prints", F.array_distinct(least)).drop("grams")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, span, window, folded): every window of every item; span is its number of words.

    Items without words have none. A null item_id is the empty string. The same text twice under one id counts once.
    """
    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        _split(F.translate(text_or_empty(), _UPPER, _LOWER)).alias("words"),
    ).where(F.size("words") > 0).withColumn("span", F.least(F.size("words"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("span") + 1)
    return rows.select("item", "span", "words", F.explode_outer(starts).alias("i")).select(
        "item", "span", F.array_join(F.slice("words", F.col("i"), F.col("span")), " ").alias("window")
    ).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row a document: n_words, n_hit words inside any occurrence of a window, n_items, items_sha256, contaminated.

    text_hash says which text of a repeated doc_id a row is about.

    A null text has no words. Rows equal in doc_id and text have equal results; null doc_ids are rows like others. Other
    columns are ignored. An empty benchmark hits nothing.
    """
    prepare(docs.sparkSession)
    wanted = store(benchmark_windows(benchmark, window), "benchmark-windows")
    spans = sorted(r.span for r in wanted.select("span").distinct().collect())  # at most `window` numbers
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).withColumn(
        "text_hash", F.xxhash64("text")
    )

    # Fingerprints. Every document also sends one row that is kept whether or not it is met, for its number of words.
    folded = rows.select("doc_id", "text_hash", _hashes(_split(F.lower("text"))).alias("hashes"))
    met, sought = folded.withColumn("all", F.array(F.struct(F.lit(0).alias("span"), F.col("text_hash").alias("print")))), None
    for span in spans:
        met = _with_prints(met, span).withColumn("all", F.concat("all", F.transform(
            "prints", lambda p: F.struct(F.lit(span).alias("span"), p.alias("print"))
        ))).drop("prints")
        own = wanted.where(F.col("span") == span).select(_hashes(F.split(F.lower("window"), " ")).alias("hashes"))
        part = _with_prints(own, span).select(F.lit(span).alias("span"), F.explode_outer("prints").alias("print"))
        sought = part if sought is None else sought.unionByName(part)
    met = met.select("doc_id", "text_hash", F.size("hashes").cast("bigint").alias("n_words"), F.explode_outer("all").alias("p"))
    met = met.select("doc_id", "text_hash", "n_words", "p.span", "p.print")
    if sought is None:
        met = met.withColumn("found", F.lit(None).cast("boolean"))
    else:  # the stored table's size is known to the planner, which broadcasts it only where it is small
        sought = store(sought.distinct().withColumn("found", F.lit(True)), "benchmark-prints")
        met = met.join(sought, ["span", "print"], "left")
    met = store(met.where(F.col("found") | (F.col("span") == 0)), "print-hits")
    sizes = met.where(F.col("span") == 0).select("doc_id", "text_hash", "n_words")

    # Extension: windows of documents with hits that hold a hit gram, compared in full.
    hit_docs = store(met.where(F.col("span") > 0).groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("span", "print")).alias("prints")
    ), "hit-documents")
    exact = rows.alias("r").join(
        hit_docs.alias("h"), F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("r.text_hash") == F.col("h.text_hash"))
    ).select("r.doc_id", "r.text_hash", "r.text", "prints").dropDuplicates(["doc_id", "text_hash"])
    exact = exact.select("doc_id", "text_hash", "prints", _split(F.translate("text", _UPPER, _LOWER)).alias("words"),
                         _hashes(_split(F.lower("text"))).alias("hashes"))
    cuts = None
    for span in spans:
        _, wide = _span(span)
        own = F.transform(F.filter("prints", lambda p: p["span"] == span), lambda p: p["print"])
        at = F.filter(F.sequence(F.lit(0), F.size("grams") - 1), lambda i: F.array_contains("own", F.get(F.col("grams"), i)))
        around = F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(
            F.greatest(i - (wide - 1), F.lit(0)), F.least(i, F.size("hashes") - span)
        ))))
        part = (
            _with_grams(exact.withColumn("own", own).where((F.size("own") > 0) & (F.size("hashes") >= span)), span)
            .withColumn("at", at).withColumn("around", around)
            .select("doc_id", "text_hash", F.explode_outer(F.transform("around", lambda i: F.struct(
                i.alias("i"), F.array_join(F.slice("words", i + 1, span), " ").alias("window")
            ))).alias("c"))
            .where("c is not null").select("doc_id", "text_hash", "c.i", F.lit(span).alias("span"), "c.window")
        )
        cuts = part if cuts is None else cuts.unionByName(part)
    if cuts is None:
        return sizes.select(
            "doc_id", "text_hash", "n_words", F.lit(0).cast("bigint").alias("n_hit"), F.lit(0).cast("bigint").alias("n_items"),
            F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"),
        )
    hits = store(cuts.join(wanted, ["span", "window"]).select("doc_id", "text_hash", "i", "span", "item"), "window-hits")
    words = hits.select("doc_id", "text_hash", "i", "span").distinct().select(
        "doc_id", "text_hash", F.explode_outer(F.sequence(F.col("i"), F.col("i") + F.col("span") - 1)).alias("word")
    ).distinct().groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n_hit"))
    items = hits.select("doc_id", "text_hash", "item").distinct().groupBy("doc_id", "text_hash").agg(
        F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items")
    )
    found = words.alias("w").join(
        items.alias("i"), F.col("w.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("w.text_hash") == F.col("i.text_hash"))
    ).select("w.doc_id", "w.text_hash", "n_hit", "n_items", "items")
    return sizes.alias("s").join(
        found.alias("f"), F.col("s.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("s.text_hash") == F.col("f.text_hash")), "left"
    ).select(
        "s.doc_id", "s.text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those that hold a benchmark window, with all their columns."""
    bad = decontaminate(docs, benchmark, window).where("contaminated").select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "text_hash"
    ).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_key().alias("key"),
                       F.xxhash64(text_or_empty()).alias("text_hash"))
    kept = rows.join(store(bad, "contaminated"), ["key", "text_hash"], "left_anti")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
