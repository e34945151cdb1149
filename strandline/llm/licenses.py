"""Licence scans: phrases, and an exact containment join of text blocks with licence templates.

Base: places where a phrase's words stand one after the other. Method: a set-similarity join. Blocks are windows over a text's
words, whatever its lines, that begin every so many words as the longest template has and are twice as long; so every stretch
as long as a template lies whole in one of them. Words are ordered by their count in the whole corpus, rarest first. A block that holds at least ``need`` = ceil(threshold x |T|) words of a template T
must hold one of the first |T| - need + 1 words of T, and that word must stand early enough in the block's own order. Only
blocks with such a word leave the scan; the join pairs them with templates by that word, the length and positional filters
drop pairs that cannot reach ``need``, and the rest is counted exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import folded_words, prepare, store, text_or_empty

# Phrases with their labels, and short licence notices with theirs, in the words of folded text.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under cc by 4 0", "cc"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
)
THRESHOLD = 0.85
SCAN = (
    "row bigint, doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>, "
    "blocks array<struct<block:int,words:int,tokens:array<int>>>"
)
_BLOCK = pa.struct([("block", pa.int32()), ("words", pa.int32()), ("tokens", pa.list_(pa.int32()))])
_SCAN = pa.schema(
    [(n, pa.int64()) for n in ("row", "doc_id", "n_words", "n_base", "first_word", "last_word")]
    + [("base", pa.list_(pa.string())), ("blocks", pa.list_(_BLOCK))]
)


def stride(templates: tuple = TEMPLATES) -> int:
    """Words from the start of one block to that of the next: those of the longest template. Blocks are twice as long."""
    return max(len(folded_words(text)) for text, _ in templates)


def template_word_counts(docs: DataFrame, templates: tuple = TEMPLATES) -> dict[bytes, int]:
    """Count of every template word in all documents. As many rows as the templates have words come to the driver."""
    vocabulary = {w for text, _ in templates for w in folded_words(text)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(w for w in folded_words(text) if w in vocabulary)
        yield pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.binary()), "n": pa.array(total.values(), pa.int64())})

    parts = docs.select(text_or_empty().alias("text")).mapInArrow(count, "word binary, n bigint")
    found = {bytes(r.word): r.n for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: found.get(w, 0) for w in vocabulary}


def phrase_places(words: list[bytes], phrases: tuple = PHRASES) -> list[tuple[int, str]]:
    """(first word, label) of every place of every phrase."""
    line, places = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases:
        needle = b" " + phrase.encode() + b" "
        at = line.find(needle)
        while at >= 0:
            places.append((line.count(b" ", 0, at), label))
            at = line.find(needle, at + 1)
    return places


def scan_licenses(
    docs: DataFrame, phrases: tuple = PHRASES, templates: tuple = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """One row a document: word count, places of phrases, base labels, and labels with the largest containment.

    A block is a window of words, see above; a text shorter than one is a block. A null text has no words. Null and repeated
    doc_ids are scanned row by row; other columns are ignored. score is the largest containment of a template in a block that
    reaches the threshold, else 0.
    """
    spark = docs.sparkSession
    prepare(spark)
    counts = template_word_counts(docs, templates)
    rank = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
    index = []  # template, label, its tokens in order, words it needs
    for number, (text, label) in enumerate(templates):
        tokens = sorted({rank[w] for w in folded_words(text)})
        index.append((number, label, tokens, math.ceil(threshold * len(tokens) - 1e-9)))
    early = {t for _, _, tokens, need in index for t in tokens[:len(tokens) - need + 1]}
    shortest = min(need for *_, need in index)
    seeds = [w for w, r in rank.items() if r in early]
    step = stride(templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        seed_set = frozenset(seeds)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, blocks = folded_words(text), []
                for base in range(0, max(len(words) - step, 1), step) if not seed_set.isdisjoint(words) else ():
                    distinct = set(words[base:base + 2 * step])
                    if len(distinct) >= shortest and not seed_set.isdisjoint(distinct):
                        tokens = sorted(rank[w] for w in distinct if w in rank)
                        if len(tokens) >= shortest:
                            blocks.append({"block": base // step, "words": len(distinct), "tokens": tokens})
                places = phrase_places(words, phrases)
                starts = [p for p, _ in places]
                out.append((
                    row, doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None),
                    sorted({label for _, label in places}), blocks,
                ))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SCAN.types)], schema=_SCAN)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    scanned = store(rows.mapInArrow(scan, SCAN), "license-scan")

    # One row for each early word of each template: as many as the templates' words, whatever the corpus.
    lists = spark.createDataFrame(
        [(t, at, number, label, tokens, need) for number, label, tokens, need in index
         for at, t in enumerate(tokens[:len(tokens) - need + 1])],
        "token int, at int, template int, label string, wanted array<int>, need int",
    )
    blocks = scanned.select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    pairs = (
        blocks.select("row", "block", "words", "tokens", F.posexplode("tokens").alias("pos", "token"))
        .join(F.broadcast(lists), "token")
        .where(F.col("words") >= F.col("need"))  # length
        .where(F.least(F.size("wanted") - F.col("at"), F.size("tokens") - F.col("pos")) >= F.col("need"))  # position
        .select("row", "block", "template", "label", "tokens", "wanted", "need").distinct()
    )
    shared = F.size(F.array_intersect("tokens", "wanted"))
    hits = pairs.where(shared >= F.col("need")).groupBy("row").agg(
        F.collect_set("label").alias("added"), F.max(shared / F.size("wanted")).alias("score")
    )
    none = F.array().cast("array<string>")
    return scanned.drop("blocks").join(hits, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("added", none))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
